"""Values after a key are candidates whatever their characters."""

from lexweave.llm import pii


def test_values_after_keys(spark):
    values = {"password=": ["correcthorse", "letmein", "opensesame", "swordfish"], "secret: ": ["hunter2", "abc", "x9", "tea-pot"], "token: ": ["8841200937551", "12", "99887766", "55-66"],
              "phone: ": ["+1 555 123 4567", "+49 30 1234567", "+44 20 7946 0958", "+33 1 2345 6789", "555-123-4567"], "note: ": ["walk", "talk", "sing", "555-123-9999"]}
    rows = [(key, v, f"we saw {key}{v} there") for key, own in values.items() for v in own]
    docs = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find(docs).collect()}
    for k, (key, value, text) in enumerate(rows):
        at = text.index(key) + len(key)
        if key == "note: ":
            assert got[k] == [""], value
        elif not value.startswith("+"):
            assert got[k] == [f"id:{at}:{at + len(value)}"], value
