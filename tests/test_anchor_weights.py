"""What is shuffled for anchors' evidence."""

from kindred.operators import anchors


def test_few_shared_tokens_are_sent_to_both_sides(spark):
    """Tokens that one side alone has are dropped where they lie: no side is shuffled by token to meet the weights."""
    rows = lambda words: spark.createDataFrame([("", i, w) for i, ws in enumerate(words) for w in ws], "pool string, id int, token string")
    left, right = rows([["a", f"l{i}", f"m{i}"] for i in range(200)] + [["b"]]), rows([["a", "b"], ["c"]])
    found = anchors.evidence(left, right, spark.createDataFrame([("", 203)], "pool string, n long"))
    assert found.count() == 201
    assert "ResolvedHint (strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString()  # noqa: SLF001
