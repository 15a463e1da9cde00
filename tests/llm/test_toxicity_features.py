from ringside.llm import toxicity


def test_uninformative_features_are_not_telling(spark):
    rows = [(k % 5, int(k % 2 == 0), [1 if k % 2 == 0 else 2, 3, *([4] if k // 2 % 2 else []), 100 + k]) for k in range(200)]
    each = spark.createDataFrame(rows, "fold int, toxic int, features array<int>")
    assert {r.feature for r in toxicity._telling(each, ["toxic"], 5, 3.0, 2048).collect()} == {1, 2}
    assert {r.feature for r in toxicity._telling(each, ["toxic"], 5, 3.0, 1).collect()} == {1}
