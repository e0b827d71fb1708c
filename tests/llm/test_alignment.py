"""Token alignment against byte-by-byte loops and the vocabulary's own library."""

import hashlib
from collections import Counter

import pytest

from lexquarry.llm.alignment import PIECES, align_tokens
from lexquarry.llm.wordbpe import vocabulary_path
from tests.llm.fixtures import documents, frame

ROWS = documents() + [
    (900, "odd ▁ mark"), (901, "nul \x00 and <0x41> <s> </s> <|endoftext|>"), (902, "日本語 emoji 🙂🙃 é ﬁ İ"), (903, "  two  spaces\n\n\ttab "), (904, " "),
    (905, "x" * 3000 + " end"), (906, "many words " * 4000), (907, "don't they'll 12345    ."), (908, "one"), (908, "one"),
]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    printed = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    back = {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printed)}
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECES))
    made = {}
    for text in {x for _, x in rows}:
        if not text:
            made[text] = None
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        a_bytes = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != b" " + text.encode() or b"".join(b_bytes) != b" " + text.encode():
            made[text] = None
            continue
        of_a = [n for n, x in enumerate(a_bytes) for _ in x]
        of_b = [n for n, x in enumerate(b_bytes) for _ in x]
        links = Counter()
        for pair in dict.fromkeys(zip(of_a, of_b, strict=True)):
            links[a[pair[0]], b[pair[1]]] += 1
        groups, i, j = [], 0, 0
        while i < len(a):
            own_a, own_b, x, y = [a[i]], [b[j]], len(a_bytes[i]), len(b_bytes[j])
            i, j = i + 1, j + 1
            while x != y:
                if x < y:
                    own_a.append(a[i])
                    x, i = x + len(a_bytes[i]), i + 1
                else:
                    own_b.append(b[j])
                    y, j = y + len(b_bytes[j]), j + 1
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
        made[text] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter()
    for _, text in rows:
        if made[text]:
            count.update(made[text][3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, text in rows:
        if not made[text]:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, digest = made[text]
        out.append((i, n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[1]]), sum(n * count[p] for p, n in links.items()), digest))
    return sorted(out, key=repr), count, most


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_matches_loops(spark, monkeypatch, block):
    monkeypatch.setattr("lexquarry.llm.alignment.BLOCK", block)
    docs = frame(spark, ROWS).repartition(3)
    got, pairs = align_tokens(docs)
    want, count, most = plain(ROWS)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == most[p[1]]) for p, n in count.items()}
    assert {r[0]: r[7] for r in want}[900] == "" and any(r[1] for r in want)


def test_nothing_to_align(spark):
    assert align_tokens(frame(spark, []))[0].collect() == []
    rows = align_tokens(frame(spark, [(1, None), (2, ""), (None, None)]))[0].collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, *[0] * 6, ""), (2, *[0] * 6, ""), (None, *[0] * 6, "")], key=repr)
