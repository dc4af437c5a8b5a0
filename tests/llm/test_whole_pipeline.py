"""Pipeline stages do the whole job: nothing of a document's own is lost."""

import random

import numpy as np

from lexweave.llm import simhash


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_short_lines_keep_a_document(spark):
    import corpus_pipeline

    licence = "This text is under the licence of the commons."
    verse = ["the moon is up", "the owl sits", "and no one sings"]
    texts = [licence + "\n" + "One long line that only the first document has.", "\n".join([licence, *verse]), licence + "\n \n", licence, None, ""]
    got = {r["doc_id"]: r for r in corpus_pipeline.lines(spark, documents(spark, texts), "").collect()}
    assert set(got) == {0, 1, 4, 5}, "verse stays, documents without anything of their own go"
    assert got[1]["text"] == "\n".join(verse) and got[1]["n_chars"] == len(got[1]["text"])


def tail_pair(rng, j, size):
    """Two texts of ``size`` shingles each whose similarity is ``j`` or a little more."""
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(size + 4)]
    cut = int(size * (1 - j) / (1 + j))
    return " ".join(words), " ".join(words[: len(words) - cut] + [f"v{rng.randint(0, 10**9)}" for _ in range(cut)]), (size - cut) / (size + cut)


def test_near_duplicates_are_decided_by_shingles(spark):
    rng = random.Random(4)
    pairs = [tail_pair(rng, 0.8 + 0.05 * k / 299, rng.choice([100, 300, 600])) for k in range(300)]
    apart = [tail_pair(rng, 0.7 + 0.09 * k / 299, rng.choice([100, 300, 600])) for k in range(300)]
    apart = [p for p in apart if p[2] < 0.8]
    texts = [t for a, b, _ in pairs + apart for t in (a, b)]
    kept = {r["doc_id"] for r in simhash.keep_first(documents(spark, texts)).collect()}
    gone = sum(2 * k + 1 not in kept for k in range(len(pairs)))
    print(f"found {gone} of {len(pairs)} pairs at 0.8 to 0.85, dropped {sum(2 * k + 1 not in kept for k in range(len(pairs), len(pairs) + len(apart)))} of {len(apart)} at 0.7 to 0.8")
    assert all(2 * k in kept for k in range(len(pairs)))
    assert gone > 0.9 * len(pairs)
    assert all(2 * k + 1 in kept for k in range(len(pairs), len(pairs) + len(apart)))


def test_links_through_members(spark):
    """A chain: neighbours are similar, ends are not."""
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(500)]
    chain = [" ".join(words[k : k + 300]) for k in (0, 15, 30, 45, 60, 75, 90)]
    order = [0, 6, 3, 1, 5, 2, 4]
    kept = {r["doc_id"] for r in simhash.keep_first(documents(spark, [chain[k] for k in order])).collect()}
    assert kept == {0}


def test_files_of_unrelated_texts_stay_empty(spark):
    """Blocks that are equal by chance make no file: their number would grow with the square of the texts'."""
    rng = np.random.default_rng(5)
    names = [*(f"f{k}" for k in range(4)), *(f"e{k}" for k in range(8))]
    rows = rng.integers(-(2**63), 2**63, (4000, len(names)))
    rows[1, :4] = rows[0, :4] ^ 1  # near each other, with all but one of the extreme hashes
    rows[1, 4:11] = rows[0, 4:11]
    made = [(k, *r, 300) for k, r in enumerate(rows.tolist())]
    distinct = spark.createDataFrame(made, ", ".join(f"{c} long" for c in ["id", *names, "n_shingles"]))
    assert {r["id"] for r in simhash._files(distinct).select("id").distinct().collect()} == {0, 1}


def test_members_are_joined_by_node(spark):
    """Near copies share most of their files: what is joined has a row for each of them, not for each file of each."""
    rng = np.random.default_rng(6)
    names = [*(f"f{k}" for k in range(4)), *(f"e{k}" for k in range(8))]
    rows = np.repeat(rng.integers(-(2**63), 2**63, (1, len(names))), 80, axis=0)
    rows[:, 0] ^= 1 << rng.integers(0, 62, 80)
    distinct = spark.createDataFrame([(k, *r) for k, r in enumerate(rows.tolist())], ", ".join(f"{c} long" for c in ["id", *names]))
    got = simhash._files(distinct).collect()
    assert sorted(r["id"] for r in got) == list(range(80))
    assert all(120 <= len(set(r["files"])) == len(r["files"]) <= 128 for r in got)
    pairs = simhash._proposed(simhash._files(distinct).selectExpr("*", "id AS root"), 2).collect()
    assert len(pairs) == 80 * 79 // 2, "no pair is lost"


def test_pairs_of_many_files_go_out_once(spark, monkeypatch):
    """A pair meets in a hundred files and more; tasks don't hand it on from each of them."""
    made = []
    real = type(spark.range(0)).mapInPandas

    def counted(self, run, schema):
        out = real(self, run, schema)
        made.append(out.count())
        return out

    rng = np.random.default_rng(7)
    names = [*(f"f{k}" for k in range(4)), *(f"e{k}" for k in range(8))]
    rows = np.repeat(rng.integers(-(2**63), 2**63, (1, len(names))), 12, axis=0)
    rows[:, 0] ^= 1 << rng.integers(0, 62, 12)
    distinct = spark.createDataFrame([(k, *r) for k, r in enumerate(rows.tolist())], ", ".join(f"{c} long" for c in ["id", *names]))
    members = simhash._files(distinct).selectExpr("*", "id AS root")
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", counted)
    assert len(simhash._proposed(members, 2).collect()) == 12 * 11 // 2
    assert made[0] <= 4 * 12 * 11 // 2, "once a task at most: there are four"
