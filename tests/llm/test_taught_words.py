"""Every taught word counts: those of one text, frequent ones in full, and all letters of long ones."""

from parchmint.llm import toxicity


def test_counts_and_letters_are_whole():
    m = toxicity.Models({"aaaaa": (100, 3), "b" * 60: (1, 0)})
    assert m.top[0]["aaaaa"] == 100 and m.top[1]["aaaaa"] == 3
    assert m.spelling("c" * 60)[2] == 61
    assert m.spelling("b" * 60)[1] != m.spelling("b" * 59 + "a")[1]


def test_words_of_one_text_are_taught(spark):
    ids = range(60)
    long = "q" * 50
    docs = spark.createDataFrame([(i, f"same words alone{'x' * (i + 1)}" + (f" idiot {long}" if i == 1 else "")) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in ids], "doc_id long, toxic int")
    taught = docs.where(toxicity.may_teach(docs["doc_id"]))
    counts = toxicity.fit(docs, labels).models.counts
    want = {w for r in taught.collect() for w in toxicity.words(r["text"])}
    assert set(counts) == want and {"idiot", long} <= want and counts["idiot"] == (0, 1)
