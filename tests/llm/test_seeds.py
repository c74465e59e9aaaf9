"""Benchmark leaks against a brute-force version."""

from __future__ import annotations

import random

import pytest

from lexiscope.llm import seeds


def words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def brute(docs, items, window, substitutions):
    """Per document and item: the first and last word in a leak, and how many there are."""
    found = {}
    for key, text in docs:
        d = words(text)
        for item, item_text in items:
            i = words(item_text)
            size, allowed = (window, substitutions) if len(i) >= window else (len(i), 0)
            if size < seeds.SHORTEST:
                continue
            places = set()
            for shift in range(-len(i) + size, len(d) - size + 1):
                for at in range(max(0, shift), min(len(d), len(i) + shift) - size + 1):
                    unlike = sum(d[at + k] != i[at + k - shift] for k in range(size))
                    if unlike <= allowed:
                        places.update(range(at, at + size))
            if places:
                found[key, item] = (min(places), max(places), len(places))
    return found


def corpus(seed):
    draw = random.Random(seed)
    text = lambda n: [f"w{draw.randrange(400)}" for _ in range(n)]
    items = [(i, text(draw.choice([3, 6, 12, 13, 14, 30, 50]))) for i in range(25)]
    docs = []
    for key in range(120):
        d = text(draw.randrange(80))
        if draw.random() < 0.6:
            part = list(draw.choice(items)[1])
            begin = draw.randrange(len(part))
            part = part[begin if draw.random() < 0.3 else 0 :]
            for _ in range(draw.randrange(7)):
                part[draw.randrange(len(part))] = "other"
            at = draw.randrange(len(d) + 1)
            d[at:at] = part
        docs.append((key, draw.choice([" ", ", ", "\n", " — "]).join(d).upper()))
    docs += [(200, None), (201, ""), (202, "."), (203, " ".join(items[-1][1] * 3))]
    return docs, [(i, " ".join(w)) for i, w in items] + [(100, None), (101, "")]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id bigint, text string, seed int, at int"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


def found_by(docs, items, **options):
    rows = seeds.find_leaks(docs, items, **options).collect()
    return {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.n_words) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    found = found_by(*frames(spark, docs, items))
    assert found == brute(docs, items, seeds.WINDOW, seeds.SUBSTITUTIONS) and len(found) > 20


def test_joins_without_broadcast_and_other_masks(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(seeds, "BROADCAST_ROWS", -1)
    masks = ((0, 1, 2, 4),)
    assert seeds.is_lossless(masks, 16, 3)
    found = found_by(*frames(spark, docs, items), window=16, substitutions=3, masks=masks)
    assert found == brute(docs, items, 16, 3)


def test_masks_that_would_miss_leaks_are_refused(spark):
    assert seeds.is_lossless(seeds.MASKS) and not seeds.is_lossless(((0, 1, 2, 3, 4, 5),))
    docs, items = frames(spark, [(1, "a")], [(1, "a")])
    with pytest.raises(ValueError):
        seeds.find_leaks(docs, items, masks=((0, 1, 2, 3, 4, 5),))


def test_documents_with_leaks_go_and_all_others_stay(spark):
    docs, items = corpus(5)
    docs += [(None, items[3][1] + " " + items[4][1]), (7, docs[7][1]), (500, "same id"), (500, items[-4][1] * 2)]
    frame, benchmark = frames(spark, docs, items)
    kept = seeds.without_leaks(frame, benchmark)
    assert kept.columns == frame.columns
    leaking = brute(list(enumerate(t for _, t in docs)), items, seeds.WINDOW, seeds.SUBSTITUTIONS)
    stay = [d for n, d in enumerate(docs) if n not in {k for k, _ in leaking}]
    order = lambda rows: sorted((k or -1, t or "") for k, t in rows)
    assert order((r.doc_id, r.text) for r in kept.collect()) == order(stay)


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus(6))
    assert seeds.find_leaks(docs.limit(0), items).collect() == []
    assert seeds.find_leaks(docs, items.limit(0)).collect() == []
    assert seeds.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_items_of_one_to_five_words_are_found_whole(spark):
    items = [(1, "Solo"), (2, "a a"), (3, "the whole item"), (4, "u v w x"), (5, "u v w x y"), (6, ".")]
    docs = [(1, "solo, then SOLO"), (2, "a a a b a"), (3, "the whole, item"), (4, "the whole"), (5, "u v w x y")]
    found = found_by(*frames(spark, docs, items))
    assert found == {
        (1, 1): (0, 2, 2), (2, 2): (0, 2, 3), (3, 3): (0, 2, 3), (5, 4): (0, 3, 4), (5, 5): (0, 4, 5),
    }
    assert found == brute(docs, items, seeds.WINDOW, seeds.SUBSTITUTIONS)
