import random
import re

import pytest

from spindlewatch.llm import decontamination as d
from spindlewatch.llm.queries import op4_decontamination

ITEM = "A train leaves the station at 60 km per hour while another train follows it 2 hours later at 90 km per hour. When do they meet?"
STORY = "Last week we told Alice that the small red box of Alice holds 12 apples and 5 pears, so we asked her how many are left over now."
PROSE = "Thor the ening of this and that, as it were with some others in a line that goes on for quite a while longer"
BENCHMARK = [(1, ITEM), (2, STORY), (3, None), (4, ""), (5, "short words only here now"), (6, " ".join("plain" + chr(97 + i) for i in range(26))), (None, PROSE)]


def found(spark, documents, rows, items=BENCHMARK):
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS hash", "2 AS at")
    docs = documents(rows).selectExpr("*", "'x' AS text_hash", "3 AS item", "4 AS id")
    out = d.judged(spark, docs, benchmark)
    assert d.clean(spark, docs, benchmark).columns == docs.columns
    assert d.clean(spark, docs, benchmark).count() == out.where("NOT contaminated").count()
    return sorted(((r.doc_id, list(r["items"])) for r in out.collect()), key=str)


def test_verbatim_and_new_parameters(spark, documents):
    plain = BENCHMARK[5][1]
    half = " ".join(plain.split()[10:23])
    rows = [
        (1, f"{PROSE}. {ITEM} {PROSE}"),
        (2, ITEM.replace("60", "45").replace("90", "75").replace("2 hours", "3 hours").replace("km", "miles")),
        (3, ITEM.upper()),
        (4, PROSE + " " + STORY.replace("Alice", "Barbara").replace("12", "31")),
        (5, STORY.replace("Alice holds", "Bob holds")),
        (6, f"{PROSE} {half} {PROSE}"),
        (7, f"{PROSE} {' '.join(half.split()[:12])} {PROSE}"),
        (8, PROSE), (9, None), (10, ""), (11, f"{PROSE}, {plain}, {ITEM}"), (None, ITEM), (1, PROSE),
        (12, "so short words only here now"), (13, "Short, words: only here now!"), (14, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"),
        (15, STORY.replace("Alice holds", "Bob holds").replace("12", "31").replace("5 pears", "6 pears")),
    ]
    # Row 5 has names that do not fit, but 16 tokens of the item as they are; row 15 has no such run.
    assert found(spark, documents, rows) == sorted([
        (1, [1]), (2, [1]), (3, [1]), (4, [2]), (5, [2]), (15, []), (6, [6]), (7, []), (8, []), (9, []), (10, []), (11, [1, 6]), (None, [1]), (1, []),
        (12, [5]), (13, [5]), (14, []),
    ], key=str)


def test_items_dense_in_placeholders(spark, documents):
    adds = "Add 12 and 7 subtract 5 from 9 divide 3 times 4 plus 6 minus 8 over 2 until 31 exceeds 44"
    bare = "3 1 4 15 9 26 5 35 8 97"
    items = [(1, adds), (2, bare), (3, "Is 17 times 3 over 50"), (4, "is 5 over 4")]
    other = adds.replace("12", "71").replace("44", "19").replace("5 from", "50 from")
    rows = [
        (1, adds), (2, f"{PROSE} {adds} {PROSE}"), (3, f"{PROSE} {other} {PROSE}"), (4, PROSE),
        (5, f"{PROSE} {bare} {PROSE}"), (6, "3 1 4 15 9 26 5 35 8 96"), (7, " ".join(str(i * 7 % 101) for i in range(300))),
        (8, "is 17 times 3 over 50"), (9, "is 18 times 4 over 51"), (10, "Is 5 over 4"),
    ]
    assert found(spark, documents, rows, items) == sorted([
        (1, [1]), (2, [1]), (3, [1]), (4, []), (5, [2]), (6, []), (7, []), (8, [3]), (9, []), (10, [4]),
    ], key=str)


def test_empty_tables(spark, documents):
    assert found(spark, documents, []) == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.judged(spark, documents([(1, ITEM)]), empty).collect()[0].contaminated is False


def test_beyond_the_broadcast_bound_nothing_changes(spark, documents, monkeypatch):
    rows = [(i, f"{PROSE} {ITEM if i % 3 else STORY} {i}") for i in range(40)] + [(99, PROSE)]
    expected = found(spark, documents, rows)
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(d, "BROADCAST_LEAKS", 0)
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    assert found(spark, documents, rows) == expected


def tokens(text):
    """The template rules, token by token."""
    out, text = [], text or ""
    for m in re.finditer(r"[^\W\d_]+|\d+(?:[.,]\d+)*|%", text):
        word = m[0]
        before = text[: m.start()]
        name = word[0].isupper() and len(word) > 1 and word[1].islower() and re.search(r"[a-zß-öø-ÿ\d,;:(] $", before)
        out.append(("#", word) if word[0].isdigit() else ("@", word.lower()) if name else (None, word.lower()))
    for i in range(1, len(out)):
        if out[i][0] is None and out[i - 1][0] == "#" and out[i][1] in d.UNITS:
            out[i] = ("&", out[i][1])
    return out


def brute(rows, items):
    def windows(ts, width):
        if len(ts) < width or (width < 5 and len(ts) != width):
            return {}
        out = {}
        for a in range(len(ts) - width + 1):
            own = ts[a : a + width]
            literals = sum(k is None for k, _ in own)
            out[a] = tuple(own) if literals < (1 if width == 8 else 4) else tuple(k or w for k, w in own)
        return out

    out = []
    for i, text in rows:
        doc, hits = tokens(text), set()
        for n, item_text in items:
            item = tokens(item_text)
            width = min(8, len(item))
            own, theirs = windows(item, width), windows(doc, width)
            dense = {a: width == 8 and sum(k is not None for k, _ in item[a : a + 8]) > 3 for a in own}
            diagonals = {}
            for b, w in theirs.items():
                for a, v in own.items():
                    if v == w:
                        diagonals.setdefault(b - a, set()).add(a)
            for shift, places in diagonals.items():
                sparse = [a for a in places if not dense[a]]
                sure = sparse and len(sparse) >= min(6, sum(not x for x in dense.values()))
                plain = sure and not any(item[b][0] for a in sparse for b in range(a, a + width))
                run = width + min(6, len(own)) - 1
                verbatim = any(a + run <= len(item) and item[a : a + run] == doc[a + shift : a + shift + run] for a in places)
                covered = {b for a in places for b in range(a, a + width)}
                pairs = {(item[b], doc[b + shift]) for b in covered if item[b][0]}
                function = len(pairs) == len({x for x, _ in pairs})
                kept_apart = {p for p in pairs if not sure or p[0][0] == "@"}
                consistent = function and len(kept_apart) == len({y for _, y in kept_apart})
                long = len(places) >= min(12, len(own)) and sum(item[b][0] is None for b in covered) >= 5
                if plain or verbatim or ((sure or long) and consistent):
                    hits.add(n)
        out.append((i, sorted(hits)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_templates_equal_the_definition(spark, documents, seed):
    rng = random.Random(seed)

    def prose(n):
        kinds = [lambda: rng.choice(["the", "of", "and", "été"]), lambda: f"w{'abcdefghij'[rng.randrange(10)]}", lambda: str(rng.randrange(9)),
                 lambda: rng.choice(["Anna", "Bert"]), lambda: rng.choice(["km", "hours", "4.5", "dog.", "cat,"])]
        return " ".join(rng.choices(kinds, [4, 6, 2, 1, 1])[0]() for _ in range(n))

    items = [(i, prose(rng.randrange(14, 30))) for i in range(8)] + [(8 + i, prose(3 + i)) for i in range(6)]
    dense = lambda n: " ".join(rng.choice([str(rng.randrange(99)), "of", "Anna", "7", f"w{'abcd'[rng.randrange(4)]}"]) for _ in range(n))
    items += [(20 + i, "so " + dense(rng.randrange(12, 40))) for i in range(6)]
    rows = []
    for i in range(60):
        text = rng.choice(items)[1]
        for _ in range(rng.randrange(3)):
            text = re.sub(r"\b%d\b" % rng.randrange(9), str(rng.randrange(9)), text)
        words = text.split()
        cut = rng.randrange(len(words) // 2)
        rows.append((i, f"{prose(rng.randrange(20))} {' '.join(words[cut:] if rng.random() < 0.4 else words)} {prose(rng.randrange(20))}"))
    assert found(spark, documents, rows, items) == brute(rows, items)


CHANGES = {
    "verbatim": lambda w: w,
    "new numbers": lambda w: re.sub(r"\d+", lambda m: str(int(m[0]) * 3 + 1), w),
    "equal numbers": lambda w: re.sub(r"\d+", "70", w),
    "new names": lambda w: {"Alice": "Yvonne", "Paris": "Oslo"}.get(w, w),
    "new units": lambda w: {"km": "miles", "kg": "pounds"}.get(w, w),
}


def test_recall_of_changed_items_and_clean_prose(spark, documents):
    """Every item of the benchmark, with numbers, names and units put between its words, changed and set in prose."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect() if r.text]
    items = []
    for n, text in enumerate(texts):
        words = re.findall(r"[a-z]+", text.lower())
        for at, put in zip((14, 11, 8, 5, 2), (f"{n + 300} kg", "Paris", f"{n + 11}", "Alice", f"{n + 5} km")):
            if at < len(words):
                words.insert(at, put)
        items.append((n, " ".join(words)))
    changed = {name: [" ".join(change(w) for w in text.split()) for _, text in items] for name, change in CHANGES.items()}
    rows = [(1000 * k + n, f"{PROSE}, {text}. {PROSE}") for k, name in enumerate(CHANGES) for n, text in enumerate(changed[name])]
    rows += [(10_000 + n, f"{PROSE} {n} {STORY} {n + 7} {PROSE}") for n in range(20)]
    got = dict(found(spark, documents, rows, items))
    assert all(got[10_000 + n] == [] for n in range(20))
    for k, name in enumerate(CHANGES):
        assert (name == "verbatim") == (changed[name] == [text for _, text in items])
        recall = sum(n in got[1000 * k + n] for n in range(len(items))) / len(items)
        print(f"recall, {name}: {recall:.3f} of {len(items)}")
        assert recall >= 0.9


def test_short_items_in_documents(spark, documents):
    items = [(1, "What is 12 plus 7?"), (2, "Name the capital of France."), (3, "Yes."), (4, "the of")]
    rows = [
        (1, f"{PROSE}. What is 12 plus 7? {PROSE}"), (2, f"{PROSE} what is 13 plus 8 {PROSE}"), (3, f"{PROSE}. Name the capital of Spain. {PROSE}"),
        (4, f"{PROSE}. Name the river of France. {PROSE}"), (5, "yes"), (6, "Yes of course the of"), (7, "the of"),
    ]
    assert found(spark, documents, rows, items) == [(1, [1]), (2, []), (3, [2]), (4, []), (5, [3]), (6, []), (7, [4])]


def test_the_query_lists_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = op4_decontamination(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    assert all(r.contaminated == (r["items"] != "") for r in rows) and {r.contaminated for r in rows} == {True, False}


def test_no_python_runs(spark, documents):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    plan = d.clean(spark, documents([(1, ITEM)]), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
