"""Reference tables: what is sound, what is told, files of each kind."""

import pytest

from hearthledger.sources import reference


def test_faults_are_told_and_the_rest_is_kept(spark):
    rows = [("food", "bakery", "Bakery"), ("food", "bakery", "Bakery"), ("Food", "x", "X"), ("food", None, "Y"), ("food", "bar", " "), ("others", "uncategorized", "Other")]
    good, problems = reference.taxonomy(spark.createDataFrame(rows, "category string, subcategory string, label string"))
    assert sorted(map(tuple, good.collect())) == [("food", "bakery", "Bakery"), ("others", "uncategorized", "Other")]
    assert sorted(r["problem"] for r in problems.collect()) == ["the category is no key", "the label is empty", "the pair is there twice", "the subcategory is no key"]
    given = [(1, "exact", "a", "food", "bakery", 1), (2, "exact", "A", "food", "bakery", 2), (3, "regex", "(a+)+", "food", "bakery", 1), (4, "regex", "a+b", "food", "pub", 1), (5, "prefix", None, "food", "bakery", None)]
    good, problems = reference.rules(spark.createDataFrame(given, "id long, match_type string, pattern string, category string, subcategory string, priority int"), good)
    assert [r["id"] for r in good.collect()] == [1]
    assert sorted((r["id"], r["problem"]) for r in problems.collect()) == [
        (2, "another rule has the pattern"), (3, "the expression is not sound"), (4, "the taxonomy lacks the pair"), (5, "the pattern is empty"), (5, "the pattern is too long"), (5, "the priority is no number of 0 or more"),
    ]


def test_a_taxonomy_without_its_fallback_is_refused(spark):
    with pytest.raises(ValueError, match="needs others"):
        reference.taxonomy(spark.createDataFrame([("food", "bakery", "Bakery")], "category string, subcategory string, label string"))


def test_tables_are_loaded_from_files(spark, tmp_path):
    schema = "category string, subcategory string, label string, rank int"
    (tmp_path / "a.csv").write_text("label,category,subcategory,more\nBakery,food,bakery,x\n")
    (tmp_path / "a.json").write_text('{"category": "food", "subcategory": "bakery", "label": "Bakery"}\n')
    for name in ("a.csv", "a.json"):
        assert [tuple(r) for r in reference.load(spark, str(tmp_path / name), schema).collect()] == [("food", "bakery", "Bakery", None)]
    with pytest.raises(ValueError):
        reference.load(spark, "a.txt", schema)
