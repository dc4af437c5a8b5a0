import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from lexweave.llm import chat, packing

CAP = packing.CAPACITY


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def optimal(lengths, capacity):
    """Fewest bins by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            go(k + 1, [r - lengths[k] * (j == i) for j, r in enumerate(rooms)])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_fewest_bins(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 11))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    fillings = packing.pack_counts(counts, 100)
    assert sum(m for _, m in fillings) == optimal(lengths, 100)
    used: dict[int, int] = {}
    for fill, many in fillings:
        assert sum(x * n for x, n in fill) <= 100
        for x, n in fill:
            used[x] = used.get(x, 0) + n * many
    assert used == counts


def test_completions_are_undominated():
    found = packing.completions(10, {7: 1, 3: 1, 2: 2, 1: 1}, 1000, least=-1)
    assert ((7, 1), (3, 1)) in found
    assert all(sum(x * n for x, n in f) <= 10 for f in found)


TEXTS = ["", None, "a", "  two  spaces \n\n and\ttabs ", "it's 12 o'clock <|endoftext|> é日本 🙂", "x" * 3000, " ".join(f"word{k}" for k in range(2500)), "same", "same", "a\x1cb c\xa0d \u2003e"]


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = vocabulary()
    reference = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = sorted(packing.pack(docs, path).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    for doc_id, own in itertools.groupby(rows, key=lambda r: r["doc_id"]):
        ids = reference.encode(TEXTS[doc_id] or "", add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for n, r in enumerate(own):
            assert (r["piece"], r["start"]) == (n, at)
            assert n == 0 or r["length"] == CAP
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= CAP


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0


HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "<|", "\n", "a\\nb", "", "é🙂"]


def test_escape_is_reversible():
    for text in [*HARD, *map("".join, itertools.product(["<", "\\", "|", "x"], repeat=5))]:
        assert "<|" not in chat.escape(text)
        assert chat.unescape(chat.escape(text)) == text


def test_chat_round_trip(spark):
    rows = [(1, k, role, text, "x") for k, (role, text) in enumerate(itertools.product(["user", "assistant", "a\nb\\"], HARD))]
    rows += [(2, 0, "user", "q", "x"), (2, 1, "assistant", None, "x"), (2, 1, "assistant", None, "x"), (None, 0, None, "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.segments(df)).collect()}
    assert set(got) == {1, 2, None}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got[1]["valid"] and not got[2]["valid"] and got[2]["first_bad_turn"] == 2


def test_chat_machine(spark):
    def valid(*roles):
        df = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        return chat.read_back(chat.segments(df)).first()["valid"]

    assert valid("user", "assistant") and valid("system", "user", "assistant", "tool", "assistant")
    assert not valid("assistant") and not valid("user", "user") and not valid("user")


def test_chat_empty(spark):
    assert chat.read_back(chat.segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
