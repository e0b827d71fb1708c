"""Simple chunks are split, and simple words merged, as the pattern and the byte-level writing have it."""

from lexquarry.llm import wordbpe as W


def test_simple_chunks_are_split_as_by_the_pattern():
    ends = [".", ",", "'", "-", ":", "7", "é", "”", "\x7f", ".,", ")\""]
    made = ["word", "don't", "'s", "<|x", "é", "a1b", ".", "9", "ﬁx", "x.y", *(w + e for w in ("word", "s", "Éa", "1", "") for e in ends)]
    for chunk in made:
        assert W.parted(chunk.encode()) == W.split_words(chunk), chunk


def test_simple_words_are_merged_as_written():
    words = ["word", "zq9", "7", "é", "naïve", "…", ".", "²", "٣"]
    tokenizer = W.load()
    written = [w.encode().decode("latin-1").translate(W._WRITTEN) for w in words]
    assert W.merged(tokenizer, words) == [[t.id for t in tokenizer.model.tokenize(w)] for w in written]
