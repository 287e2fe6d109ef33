"""Sets that fill few parts of the universe: linked sets that fill more of them do not name their empty parts."""

from __future__ import annotations

import numpy as np

from folioforge.llm import jaccard

U64 = np.uint64
PARTS = 4  # of the class of 19 to 27 shingles; linked sets of 20 differ in two at most


def part(h):
    return int(jaccard.mix(U64(h) ^ U64(0x5851F42D4C957F2D)) % U64(PARTS))


def text(start, parts, n):
    """A text of ``n`` shingles after ``start``, each in its part of ``parts`` (the last one for all others)."""
    words = list(start)
    i = 0
    while len(words) < n + 2:
        at = parts[min(len(words) - 2, len(parts) - 1)]
        while True:
            i += 1
            if part(jaccard.shingles(" ".join([*words[-2:], f"w{i}"]), 3)[0]) in at:
                words.append(f"w{i}")
                break
    return words


def test_linked_sets_of_two_and_of_three_filled_parts(spark):
    """A text of two filled parts, and for each of them a linked one that is equal in that part alone."""
    few = text(["a", "b"], [{0}] + [{0, 1}], 20)
    others = []
    for same, changed in ((0, 1), (1, 0)):
        for i in range(100_000):  # one more shingle in the other part, and one in a third
            t = [*few, f"x{i}", f"y{i}"]
            last = [part(jaccard.shingles(" ".join(t[j : j + 3]), 3)[0]) for j in (20, 21)]
            if last[0] == changed and last[1] == 2:
                others.append(t)
                break
    texts = [" ".join(t) for t in (few, *others)]
    assert {part(h) for h in jaccard.shingles(texts[0], 3)} == {0, 1}
    # the first is linked with both others, over another part each: 20 of 22 shingles
    rows = jaccard.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(0, 20, 0), (1, 22, 0), (2, 22, 0)]
