"""Fill-in-the-middle, decontamination and vector codes against plain Python, on small tables with every odd case."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.llm import leaks, middle, vectors
from tidepool.llm.common import Staging

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
#: A column of that name and others that clash with inner ones.
EXTRA = "`a.b` string, n string, form string, k1 string, phrase string, h1 string, id string, label2 string"
FILL = ("x",) * 8


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


# --- fill in the middle -----------------------------------------------------------------------------------------------------
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    text = text or ""
    units, h = UNIT.findall(text), sha(f"42:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    spm = h4 % 100 < 80
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def texts(seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(["a", "b", " ", "\n", "é", "漢", "\x85", "\t", "<", "<S", ">", "😀", "\x0b"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [None, "", " ", "\n\n", "a", " a", "a ", "a<P>b c", "x <M> y", *made, "word é " * 5000, " " * 300]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_middle_equals_plain_python(spark, chunk):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all"), (5, " a"), (5, " a")]
    docs = spark.createDataFrame([(*r, *FILL) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3)
    made = middle.fill_in_middle(docs, chunk=chunk)
    assert rows_of(made) == sorted(repr(by_hand(*r)) for r in rows)
    back = made.select("doc_id", middle.restore(F.col("output"), F.col("form")).alias("t"))
    assert rows_of(back) == sorted(repr((i, t or "")) for i, t in rows)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_middle_counts_in_groups(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(middle, "GROUP", 16)
    data = ("ab c  d" * 30).encode() + b"x y " + b"z"
    bounds = np.array([0, 210, 214, 214, 215])
    chunks = middle.Chunks(np.frombuffer(data, np.uint8), bounds, 5)
    parts = [data[a:z].decode() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    assert chunks.units.tolist() == [len(UNIT.findall(p)) for p in parts]
    for i, p in enumerate(parts):
        units = UNIT.findall(p)
        assert [chunks.cut(i, k) - bounds[i] for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_middle_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert middle.fill_in_middle(none).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert middle.fill_in_middle(none).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------------
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return TOKEN.findall((text or "").translate(LOWER))


def contaminated(docs, items, size):
    out = []
    for d, text in docs:
        w, hit, ids = tokens(text), set(), set()
        for i, t in items:
            v = tokens(t)
            for a in range(max(len(v) - size + 1, 1) if v else 0):
                win = v[a : a + size]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        if i is not None:
                            ids.add(str(i))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(map(repr, out))


def leak_tables(seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "and", "é", "ÉCOLE", "x1", "42", *("w" + chr(97 + i) for i in range(20))]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([2, 4, 6, 12]))) for i in range(25)] + [(30, "of"), (31, ""), (32, None), (33, "..."), (None, "the of"), (7, say(5)), (34, "zebra zebra zebra"), (35, say(4) + " nowhere")]
    docs = [(i, say(rng.choice([0, 1, 3, 40, 120]))) for i in range(60)]
    docs += [(100 + i, say(9) + "; " + (items[i][1] or "") + " - " + say(5)) for i in range(25)]
    docs += [(200, None), (201, "!!!"), (None, "The, Of"), (None, "The, Of"), (202, "zebra zebra zebra zebra zebra"), (100, docs[60][1]), (100, docs[60][1]), (100, "another text of that id"), (203, say(4000))]
    return docs, items


@pytest.mark.parametrize("few", [250_000, 0])
@pytest.mark.parametrize("size", [3, 10])
def test_leaks_equal_plain_python(spark, monkeypatch, few, size):
    monkeypatch.setattr(leaks, "FEW", few)  # 0: all by shuffles
    docs, items = leak_tables()
    d = spark.createDataFrame([(*r, *FILL) for r in docs], f"doc_id long, text string, {EXTRA}").repartition(3)
    i = spark.createDataFrame([(*r, *FILL) for r in items], f"item_id long, text string, {EXTRA}")
    assert rows_of(leaks.decontaminate(d, i, size=size)) == contaminated(docs, items, size)


def test_leaks_of_nothing(spark):
    docs, items = leak_tables()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks.decontaminate(d.limit(0), i).count() == 0
    assert rows_of(leaks.decontaminate(d, i.limit(0))) == contaminated(docs, [], 10)


@pytest.mark.parametrize("few", [250_000, 0])
def test_near_matches_equal_plain_python(spark, monkeypatch, few):
    monkeypatch.setattr(leaks, "FEW", few)
    docs, items = leak_tables(5)
    staging = Staging(spark)
    found, _ = leaks.phrases(staging, spark.createDataFrame(items, "item_id long, text string"), size=3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = leaks.build_index(staging, d, found.select(F.explode("words").alias("term")).distinct())
    keys = d.select(F.col("text"), *leaks._key("doc_id", "text")).distinct()
    within = 5
    got = rows_of(index.near_matches(found, within).join(keys, ["k1", "k2"]).join(found, "phrase").select("text", "words", "start", "length").distinct())
    want = set()
    for text in {t for _, t in docs if t}:
        w = tokens(text)
        for win in {tuple(tokens(t)[a : a + 3]) for _, t in items if tokens(t) for a in range(max(len(tokens(t)) - 2, 1))}:
            places = []
            for s in range(len(w)):
                for e in range(s + 1, min(s + within, len(w)) + 1):
                    if set(win) <= set(w[s:e]):
                        places.append((s, e))
                        break
            shortest = [(s, e) for s, e in places if not any(s <= a and b <= e and (a, b) != (s, e) for a, b in places)]
            want |= {repr((text, list(win), s, e - s)) for s, e in shortest}
    assert got == sorted(want)
    assert want


# --- vector codes -----------------------------------------------------------------------------------------------------------
def coded_by_hand(rows, parts, entries, rounds):
    """rows: id, label, vector. Plain integers, row by row."""
    fine = [(i, g, v) for i, g, v in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in fine if r[0] is not None), key=lambda r: (r[0], r[2]))
    if not first:
        return [], None
    width = len(first[0][2])
    fine = [r for r in fine if len(r[2]) == width]
    step = width // parts
    cut = lambda v: [[max(-(2**24), min(2**24, math.floor(256 * x))) for x in v[p * step : (p + 1) * step]] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, _, v in [r for r in first if len(r[2]) == width][:entries]), strict=True)]
    vecs = [cut(v) for _, _, v in fine]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda: [[min((far(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(v)] for v in vecs]
    for _ in range(rounds):
        sums = defaultdict(lambda: [0, [0] * step])
        for v, b in zip(vecs, best(), strict=True):
            for p, (_, e) in enumerate(b):
                at = sums[p, e]
                at[0] += 1
                at[1] = [x + y for x, y in zip(at[1], v[p], strict=True)]
        for (p, e), (n, s) in sums.items():
            books[p][e] = [x // n for x in s]
    final = best()
    errors = [sum(d for d, _ in b) for b in final]
    by = Counter()
    for (_, g, _), e in zip(fine, errors, strict=True):
        by[g] += e
    digest = sha(",".join(str(x) for b in books for c in b for x in c))
    return [(i, "".join(f"{e:02x}" for _, e in b), err, by[g], digest) for (i, g, _), b, err in zip(fine, final, errors, strict=True)], digest


def vector_rows(seed=2, n=120, width=32):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, None, 5 + i % 30]), [rng.choice([-1.0, 0.5, 0.1, 0.25]) * rng.random() for _ in range(width)]) for i in range(n)]
    rows += [(3, 1, rows[3][2]), (3, 2, rows[4][2]), (None, 1, rows[5][2]), (500, 1, None), (501, 1, []), (502, 1, [float("nan")] * width), (503, None, [float("inf")] * width), (504, 1, [None] * width), (505, 1, [0.0] * (width // 2)), (506, 1, [0.0] * (width + 1)), (507, 7, [3e38] * width), (508, 7, [-3e38] * width)]
    rows += [(600 + i, 1, rows[7][2]) for i in range(30)]
    rng.shuffle(rows)
    return rows


VECTORS = "vec_id long, label int, embedding array<float>"


def singles(rows):
    import struct

    return [(i, g, v and [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, g, v in rows]


@pytest.mark.parametrize(("entries", "rounds", "few", "slice_"), [(64, 2, 250_000, 4096), (8, 4, 2, 16), (200, 1, 0, 7)])
def test_codes_equal_plain_python(spark, monkeypatch, entries, rounds, few, slice_):
    monkeypatch.setattr(vectors, "SLICE", slice_)
    rows = singles(vector_rows())
    table = spark.createDataFrame([(*r, *FILL) for r in rows], f"{VECTORS}, {EXTRA}").repartition(3)
    coded, books = vectors.compress(table, entries=entries, rounds=rounds)
    out = vectors.with_group_sum(coded, "label", "error", "label_error", few)
    want, digest = coded_by_hand(rows, 16, entries, rounds)
    assert vectors.digest(books) == digest
    assert rows_of(out.select("id", "code", "error", "label_error", F.lit(digest))) == sorted(map(repr, want))


def test_only_changes_move(spark):
    """After a round in which nothing changed, nothing is moved and the codebooks stay."""
    rows = [(i, 1, [float(i % 2)] * 16) for i in range(50)]
    kept = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    import numpy as np

    books = np.ascontiguousarray(vectors.scaled(np.array([[0.0] * 16, [1.0] * 16])).reshape(2, 16, 1).transpose(1, 0, 2))
    table = Staging(spark).put(vectors._round(kept, books, False, True), "t")
    again = vectors._round(table.where("part IS NULL").select("id", "label", "vec", "codes"), books, True, False)
    assert again.count() == 0
    assert table.where("part IS NOT NULL").agg(F.sum("n")).first()[0] == 50 * 16


def test_codes_of_nothing(spark):
    for rows in ([], [(1, 1, None), (2, 2, [1.0] * 5)], [(None, 1, [1.0] * 16)]):
        coded, books = vectors.compress(spark.createDataFrame(rows, VECTORS))
        assert coded.count() == 0
        assert vectors.with_group_sum(coded, "label", "error", "label_error").count() == 0
        assert books.shape == (16, 0, 0)
