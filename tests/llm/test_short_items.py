from shardwright.llm import decontaminate


def test_exact_copies_of_short_items(spark):
    items = [(1, "What is the capital of Peru?"), (2, "who wrote, this old book"), (3, "What is the capital of Peru?"), (4, "What is the  capital of peru"),
             (5, "--"), (6, None), (7, "Peruvian"), (8, "one two three four five six seven eight nine ten")]
    rows = [(1, "Some words. What is the capital of PERU? What is the capital of Peru."), (2, "what is the big capital of peru"), (3, "Who wrote this old book"),
            (4, "who wrote this very old book"), (5, None), (6, "the capital of Peru"), (None, "a Peruvian text"), (7, "one two three four five six seven eight nine ten")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (4 << 20, 20):
        got = {(r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in decontaminate.find_leaks(docs, bench, block_bytes=block).collect()}
        assert got == {(1, 1, 1.0, 2, 8), (1, 3, 1.0, 2, 8), (1, 4, 1.0, 2, 8), (3, 2, 1.0, 0, 5), (None, 7, 1.0, 1, 2), (7, 8, 1.0, 0, 10)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {2, 4, 5, 6}
