"""What a Python worker holds from one step to the next."""

from pathlib import Path

from lexquarry.llm import jaccard, quality, wordbpe


def _resident() -> int:
    return int(next(x for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("VmRSS")).split()[1]) * 1024


def test_a_tidy_task_drops_what_other_steps_kept():
    first = wordbpe.per_worker("test", list)
    assert wordbpe.per_worker("test", list) is first
    assert list(wordbpe.tidy(iter)([1, 2])) == [1, 2]
    assert wordbpe.per_worker("test", list) is not first
    wordbpe.give_back()


def test_a_tidy_task_gives_its_memory_back():
    def run(batches):
        held = [bytes(100_000) for _ in batches]  # 200 MB below the size that the C library maps apart
        kept.append(bytes(1000))  # lies behind it
        yield len(held)

    kept: list[bytes] = []
    before = _resident()
    assert list(wordbpe.tidy(run)(range(2000))) == [2000] and _resident() - before < 50_000_000


def test_the_steps_of_the_pipeline_are_tidy(spark):
    docs = spark.createDataFrame([(n, f"some words of text {n} and the end of it") for n in range(8)], "doc_id long, text string").coalesce(1)

    def keep(batches):
        wordbpe.per_worker("probe", list)
        yield from batches

    def count(batches):
        for batch in batches:
            yield batch.slice(0, min(1, batch.num_rows)) if "probe" in wordbpe._KEPT else batch.slice(0, 0)

    for step in (lambda: jaccard.jaccard_components(docs).collect(), lambda: quality.score_quality(docs, quality.GatedAttention()).collect()):
        docs.mapInArrow(keep, docs.schema).collect()
        step()
        step()
        assert docs.mapInArrow(count, docs.schema).count() == 0
