"""Near-duplicates, line dedup and decontamination against plain comparisons of all pairs."""

import random

import numpy as np
import pytest

from kairograph.llm import decontaminate, golay, linededup, session, simhash
from kairograph.llm.components import components

from .helpers import contained, dedup_lines, docs, near_components, odd_rows, one_of_each, thue_morse, words


def key(rows):
    return sorted(rows, key=repr)


def near_rows():
    r, rows = random.Random(3), odd_rows()
    base = words(400, 77).split()
    for k in range(60):
        copy = list(base)
        for _ in range(k % 4):
            copy[r.randrange(400)] = "x" + str(r.randrange(5))
        rows.append((500 + k, " ".join(copy).upper() if k % 7 == 0 else " ".join(copy), "en"))
    return rows


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_near_duplicates_are_those_of_all_pairs(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "links", lambda p, f=simhash.links: f(p, crowd=crowd))
    rows = near_rows()
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    assert key((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found) == key(near_components(rows))
    assert len({r.component_id for r in found}) < len(rows)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = near_rows() + [(501, words(70, 88), "fr"), (None, words(70, 89), "fr"), (None, words(70, 89), "en"), (None, words(70, 90), None)]
    found = simhash.keep_one(docs(spark, rows)).collect()
    assert key((r.doc_id, r.text, r.lang) for r in found) == key(rows[k] for k in one_of_each(rows))
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_golay_spheres_cover_every_word_once():
    _, size = np.unique(golay.decode(np.arange(1 << 23)), return_counts=True)
    assert len(size) == 4096 and set(size.tolist()) == {2048}


def test_words_one_bit_apart_share_a_key():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 2000)
    y = x ^ (1 << r.integers(0, 23, 2000))
    assert (golay.nearby(y) == golay.decode(x)[:, None]).any(axis=1).all()


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components_of_chains_stars_and_loops(spark, local):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), local=local).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), local=local).count() == 0


def line_rows():
    a, b = "one\ntwo\nthree\nfour", "\n\n\n\n"
    return odd_rows() + [(300, f"x\n{a}\ny", "en"), (301, f"{a}\nz\n{a}", "en"), (302, a, "en"), (303, b, "en"), (304, b, "fr"), (305, "s\n" * 9, "en"), (305, "s\n" * 4, "en"), (302, a, "en"), (None, a, "en"), (None, a + "\nfive", None)]


def test_lines_are_those_of_a_plain_scan(spark):
    found = linededup.dedup_lines(docs(spark, line_rows())).collect()
    assert key((r.doc_id, r.text, r.lang) for r in found) == key(dedup_lines(line_rows()))
    assert all(r.th == "th" and r.covered == "covered" for r in found)
    by_id = {r.doc_id: r for r in found}
    assert (by_id[300].n_lines, by_id[100].n_lines, by_id[100].n_removed, by_id[101].n_lines) == (6, 0, 0, 1)


def test_lines_of_nothing(spark):
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def leak_rows():
    items = [(k, words(25 + k, 4000 + k)) for k in range(6)] + [(9, "too short"), (10, None), (11, words(25, 4000)), (0, words(25, 4000))]
    text = dict(items)
    cut = text[1].split()
    rows = odd_rows() + [(700, words(900, 5) + " " + text[0].upper() + "\n" + words(900, 6), "en"), (701, " ".join(cut[:-4]), "en"), (702, " ".join(cut[: len(cut) // 2]), "en"), (703, text[2].replace(" ", " \t"), "en"), (704, text[3] + " " + text[4], None), (700, "a second row of one id", "en"), (None, text[5], "en")]
    return rows, items


@pytest.mark.parametrize(("bits", "broadcast"), [(decontaminate.BITS, 10_000), (7, 10_000), (decontaminate.BITS, 0)])
def test_contained_items_are_those_of_all_pairs(spark, bits, broadcast, monkeypatch):
    """With few bits the bitmaps let nearly everything through, and the join alone decides."""
    monkeypatch.setattr(decontaminate, "BITS", bits)
    monkeypatch.setattr(decontaminate, "small", lambda d, n=broadcast: session.small(d, n and broadcast))
    rows, items = leak_rows()
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contained_items(docs(spark, rows), table).collect()
    want = contained(rows, items)
    assert key((r.id, r.item_id, r.shared, r.item_shingles) for r in found) == key((i, item, s, n) for i, _, item, s, n in want)
    assert {r.item_id for r in found} >= {0, 2, 3, 4, 5, 11}
    left = decontaminate.decontaminate(docs(spark, rows), table).collect()
    gone = {(i, t) for i, t, _, _, _ in want}
    assert key((r.doc_id, r.text) for r in left) == key((i, t) for i, t, _ in rows if (i, t) not in gone)


def test_repeated_rows_and_items_count_once(spark):
    """Half of an item given twice is half of it; all of it given twice is found once; items scattered over a text are found."""
    text = words(24, 8000).split()
    scattered = "  ".join(" ".join(text[k : k + 5]) + f"\tx{k}" for k in range(20))
    rows = [(1, " ".join(text[:14]), "en")] * 3 + [(2, "so " + " ".join(text) + " on", "en")] * 2 + [(3, scattered, "en"), (2, " ".join(text[:14]), "en"), (None, " ".join(text), None), (None, " ".join(text), None)]
    items = [(1, " ".join(text)), (1, " ".join(text)), (2, " ".join(text[:12])), (2, " ".join(text[4:9])), (3, "a " + " ".join(thue_morse(1024)) + " b c d"), (4, "a " + " ".join(thue_morse(1024)[::-1]) + " b c d")]
    rows += [(10, items[4][1], "en"), (11, items[5][1], "en")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contained_items(docs(spark, rows), table).collect()
    grams = {item: set().union(*({" ".join(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in items if i == item)) for item, _ in items}
    want = set()
    for i, t, _ in rows:
        own = {" ".join(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)}
        want |= {(i, t, item, len(own & g), len(g)) for item, g in grams.items() if 5 * len(own & g) >= 4 * len(g)}
    assert key((r.id, r.item_id, r.shared, r.item_shingles) for r in found) == key((i, *x) for i, _, *x in want)
    assert {(3, 1, 20, 20), (2, 1, 20, 20), (10, 3, 2, 2), (11, 4, 2, 2)} <= {(r.id, r.item_id, r.shared, r.item_shingles) for r in found}
    assert not {(10, 4), (11, 3), (1, 1)} & {(r.id, r.item_id) for r in found}


def test_every_partition_finds_what_all_pairs_find(spark):
    """Items of many sizes, with all, just enough, and one too few of their shingles in long documents."""
    r = random.Random(1)
    items, rows = [], []
    for k, n in enumerate([5, 6, 9, 12, 20, 33, 64, 65, 130, 300]):
        item = [f"w{r.randrange(10**6)}" for _ in range(n)]
        items.append((k, " ".join(item)))
        size = n - 4
        for j, missing in enumerate((0, size - -(-size * 4 // 5), size - -(-size * 4 // 5) + 1)):
            rows.append((100 * k + j, words(300, j) + " " + " ".join(item[: n - missing]) + " " + words(500, k), "en"))
    found = decontaminate.contained_items(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = contained(rows, items)
    assert key((x.id, x.item_id, x.shared) for x in found) == key((i, item, s) for i, _, item, s, _ in want) and len(want) == 20


def test_nothing_to_contain(spark):
    rows, _ = leak_rows()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs(spark, rows), empty).count() == 0
    assert decontaminate.decontaminate(docs(spark, rows), empty).count() == len(rows)
    assert decontaminate.decontaminate(docs(spark, []), empty).count() == 0
