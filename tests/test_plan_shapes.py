"""How often texts are shuffled and passed to Python, told by plans."""

import random
import tracemalloc

import numpy as np
import pytest

from gridlore.operators import chunking, retrieval
from gridlore.plans import queries

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_strategies_are_compared_in_one_pass(spark):
    """One pass in Python for all structured strategies, one merge of texts for all fixed ones, one aggregation."""
    made = plan(queries.strategy_comparison(spark, SMALL))
    assert made.count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in made and made.count("Window ") <= 4


def test_a_paragraph_over_many_pages(spark):
    """Pieces are as if its lines were joined; each has the paragraph's pages and labels, told once."""
    lines = ["one. two", "three! ", "", "x" * 25, "end.", ". ."]
    whole, size = " ".join(lines), 12
    want = []
    for sentence in filter(None, chunking.SENTENCE.split(whole)):
        if want and len(want[-1]) + len(sentence) <= size:
            want[-1] += sentence
        else:
            want += [sentence[k : k + size] for k in range(0, len(sentence), size)]
    assert list(chunking.cut_long(lines, size)) == want and list(chunking.cut_long(lines, 500)) == [whole]


def test_a_sentence_over_many_lines():
    """It is cut as its lines come, so that its memory is a piece's, not the file's."""
    lines = ["x" * 100] * 50000
    tracemalloc.start()
    cut = sum(map(len, chunking.cut_long(lines, 600)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cut == len(lines) * 101 - 1 and peak < 1 << 20


@pytest.mark.parametrize("size", [1, 2, 5, 9, 30])
def test_pieces_are_whole_sentences_while_they_fit(size):
    rng = random.Random(size)
    for _ in range(300):
        lines = ["".join(rng.choices("ab .。！", k=rng.randrange(1, 12))) for _ in range(rng.randrange(1, 9))]
        whole, want = " ".join(lines), []
        for sentence in filter(None, chunking.SENTENCE.split(whole)):
            if want and len(want[-1]) + len(sentence) <= size:
                want[-1] += sentence
            else:
                want += [sentence[k : k + size] for k in range(0, len(sentence), size)]
        assert list(chunking.cut_long(lines, size)) == (want if len(whole) > size else [whole])


def test_a_page_of_many_captions():
    """A caption's rows are read, not all lines below it up to the page's end."""

    class Counted(list):
        looks = 0

        def __getitem__(self, k):
            self.looks += 1
            return super().__getitem__(k)

    lines = Counted(chunking.Line(text, 0, None, None) for k in range(1000) for text in (f"表 1-{k} t", "a", "b", "c", "d"))
    blocks = chunking.to_blocks(lines)
    assert [b.title for b in blocks] == [f"表 1-{k} t" for k in range(1000)] and {len(b.groups) for b in blocks} == {4}
    assert lines.looks < 10 * len(lines)


def test_documents_of_a_page_are_no_groups(spark):
    """Structured chunks stream through Arrow batches: no call of Python for each document, no window over texts."""
    made = plan(queries.chunk_structured_600_100(spark, SMALL))
    assert "FlatMapGroupsInPandas" not in made and "Window " not in made


def test_fixed_windows_of_a_report_are_not_numbered(spark):
    """One place for all sizes: windows over lengths alone, no texts in them."""
    made = plan(queries.chunk_stats_by_strategy(spark, SMALL))
    assert made.count("Window ") <= 4


def test_memory_of_distances(spark):
    """A block of 65,536 vectors met by 200 questions needs little beside the block itself."""
    rng = np.random.default_rng(1)
    x, asked = rng.normal(size=(65536, 64)), rng.normal(size=(200, 64))
    norms = [np.sqrt((v * v).sum(axis=1)) for v in (x, asked)]
    tracemalloc.start()
    got = list(retrieval._nearest(x, norms[0], np.arange(len(x)), asked, norms[1], 31))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    want = 1.0 - asked @ x.T / norms[1][:, None] / norms[0]
    assert all(set(near) == set(np.argsort(want[q])[:31]) for q, near, _ in got)
