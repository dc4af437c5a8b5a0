import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, graph, line_dedup, simhash


def make(spark, texts, extra="x"):
    return spark.createDataFrame([(k, t, extra, extra) for k, t in enumerate(texts)], "doc_id long, text string, component_id string, fp string")


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def united(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def variants(rng, n):
    base = [[f"w{rng.randint(0, 500)}" for _ in range(rng.randint(30, 300))] for _ in range(n // 6)]
    out = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"v{k}"
        out.append(" ".join(words))
    return out


def test_simhash_components(spark):
    rng = random.Random(4)
    texts = variants(rng, 240) + [None, "", " \n", "one", "One", "one two", "é É", "x y z " * 5000]
    rows = sorted(simhash.near_duplicates(make(spark, texts)).collect(), key=lambda r: r["doc_id"])
    fps = [brute_fingerprint(t) for t in texts]
    assert [r["fingerprint"] for r in rows] == [f"{f:016x}" for f in fps]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert [r["component_id"] for r in rows] == united(len(fps), pairs)
    assert simhash.near_duplicates(make(spark, ["x"]).limit(0)).count() == 0


def test_links_in_large_files(spark, monkeypatch):
    """With tiny files allowed, nearly all links come from the midpoint stars."""
    monkeypatch.setattr(simhash, "SMALL_FILE", 2)
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(60)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    member = {r["node"]: r["root"] for r in graph.components(simhash.links(df)).collect()}
    mine = [member.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64))) for f in fps]
    want = united(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001 + k) for k in range(50)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1001 + k] == 1000 for k in range(50)) and got[5001] == 5000
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, width=5):
    w = text.lower().split()
    return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}


def test_similar_groups(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(120, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, len(words) // 90)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    texts += [None, "", "short", "short", "other"]
    kept = {r["doc_id"] for r in simhash.keep_first(make(spark, texts)).collect()}
    s = [shingles(t) if t and t.split() else set() for t in texts]
    similar = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8]
    root = united(len(texts), similar)
    caught = [k for k in range(len(texts)) if root[k] != k and k not in kept]
    assert len(caught) >= 0.9 * sum(root[k] != k for k in range(len(texts)))
    alone = [k for k in range(len(texts)) if all(len(s[k] & s[j]) / max(1, len(s[k] | s[j])) < 0.5 for j in range(len(texts)) if j != k)]
    assert set(alone) <= kept
    assert {len(texts) - 5, len(texts) - 4} <= kept, "documents without words stay"


# --- lines ------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def mutate(rng, text, edits):
    c = list(text)
    for _ in range(edits):
        at = rng.randrange(len(c))
        what = rng.random()
        if what < 0.33:
            c.insert(at, rng.choice("abé🙂"))
        elif what < 0.66:
            del c[at]
        else:
            c[at] = rng.choice("xyz")
    return "".join(c)


def test_edit_distance(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abcdé🙂") for _ in range(rng.randint(20, 90)))
        b = mutate(rng, a, rng.randint(0, 5))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(line_dedup.edit_distance_within(line_dedup.characters(F.col("a")), line_dedup.characters(F.col("b"))).alias("d")).collect()
    for (a, b), r in zip(pairs, got, strict=True):
        true = distance(a, b)
        assert r["d"] == true if true <= 2 else r["d"] > 2, (a, b, true, r["d"])


def brute_dedup(texts):
    lines = [[(line, line.strip(" \t\r\x0b\f")) for line in (t or "").split("\n")] for t in texts]
    distinct = list(dict.fromkeys(s for doc in lines for _, s in doc if len(s) >= line_dedup.MIN_CHARS))
    count = np.array([np.bincount(np.frombuffer(s.encode(), np.uint8), minlength=256) for s in distinct]).reshape(len(distinct), 256)
    near = ((a, b) for a in range(len(distinct)) for b in np.flatnonzero(np.abs(count[:a] - count[a]).sum(1) <= 16).tolist())  # two edits change 16 bytes at most
    root = united(len(distinct), [(a, b) for a, b in near if abs(len(distinct[a]) - len(distinct[b])) <= 2 and distance(distinct[a], distinct[b]) <= 2])
    place = {s: root[k] for k, s in enumerate(distinct)}
    first: dict[int, int] = {}
    out = []
    for k, doc in enumerate(lines):
        kept, here = [], set()
        for line, s in doc:
            if len(s) >= line_dedup.MIN_CHARS:
                c = place[s]
                if first.setdefault(c, k) != k or c in here:
                    continue
                here.add(c)
            kept.append(line)
        out.append("\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdef é") for _ in range(rng.randint(15, 70))) for _ in range(40)]
    texts = ["\n".join(mutate(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += [None, "", "\n\n", "short\nshort", texts[0], " " + pool[0] + "\r\n" + pool[0] + "\n" + pool[0], "z" * 900, "z" * 901 + "\nq"]
    rows = sorted(line_dedup.dedup(make(spark, texts)).collect(), key=lambda r: r["doc_id"])
    want = brute_dedup(texts)
    assert [r["text"] or "" for r in rows] == want
    assert rows[60]["text"] is None
    assert len(rows) == len(texts)
    assert line_dedup.dedup(make(spark, ["x"]).limit(0)).count() == 0


def test_line_dedup_takes_no_python(spark):
    plan = line_dedup.dedup(make(spark, ["a line that is long enough to count"]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# --- decontamination ---------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    items = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(30)]
    filler = [word() for _ in range(400)]
    texts, want = [], set()
    for k in range(120):
        words = [rng.choice(filler) for _ in range(rng.randint(60, 400))]
        if k % 3 == 0:
            i = rng.randrange(30)
            own = items[i].split()
            if k % 2:  # a paraphrase: some words replaced
                for _ in range(len(own) // 8):
                    own[rng.randrange(len(own))] = rng.choice(filler)
            at = rng.randrange(len(words))
            words[at:at] = own
            want.add((k, i))
        texts.append(" ".join(words))
    texts += [None, "", items[0].upper()]
    want.add((122, 0))
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(98, None), (99, "too short")], "item_id long, text string")
    d = make(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, bench).collect()}
    assert got == want
    clean = decontaminate.clean(d, bench)
    assert clean.columns == d.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {k for k, _ in want}
    assert decontaminate.leaks(d, bench.limit(0)).count() == 0
    assert decontaminate.leaks(d.limit(0), bench).count() == 0


@pytest.mark.parametrize(("a", "b", "n"), [("a b c", "a x b y c", 3), ("a b", "c", 0), ("a a", "a", 1), ("", "a", 0), ("b a", "a b", 1)])
def test_lcs(a, b, n):
    assert decontaminate.lcs_length(a.encode().split(), b.encode().split()) == n


def test_counts_and_segments_of_wide_characters(spark):
    """Bytes stand for characters only where they are the same."""
    lines = ["the owl sits on the old oak tree", "die Käuzin saß über dem Fluß, öde", "日本語の辞書 is a dictionary of words", "naïve 😀 owls eat mice at night"]
    measured = line_dedup.measured(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    gray = lambda n: n & 3 ^ (n & 3) >> 1
    for r in measured.collect():
        many = [r["line"].count(x) for x in line_dedup.LETTERS]
        many.append(len(r["line"]) - sum(many))
        assert (r["len"], r["counts"]) == (len(r["line"]), sum(gray(n) << 2 * k for k, n in enumerate(many)))
    texts = spark.createDataFrame([(k, n, i, line[at : at + size]) for k, line in enumerate(lines) for n in [len(line)]
                                   for i, at, size in ((1, 0, n // 3), (2, n // 3, n // 3 + (n % 3 > 1)), (3, 2 * (n // 3) + (n % 3 > 1), n // 3 + (n % 3 > 0)))], "id long, n int, i int, part string")
    keys = texts.selectExpr("id", "xxhash64(n, i, part) AS key")
    index, _ = line_dedup.segment_rows(measured)
    assert sorted(index.select("id", "key").collect()) == sorted(keys.collect())
