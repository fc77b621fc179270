"""Facts of a small tree of our own, as rows of the operators."""

from pyspark.sql import functions as F

from quarrylight.operators import extract

# A small source tree of our own, whose facts are known.
JAVA = {
    "shop/Base.java": "package shop;\n\npublic abstract class Base {\n    protected int stock;\n    public void sell(int n) { stock -= n; }\n    abstract String label();\n}\n",
    "shop/web/Shelf.java": "package shop.web;\n\nimport org.springframework.web.bind.annotation.GetMapping;\nimport shop.Base;\n\npublic class Shelf extends Base {\n    @GetMapping({\"/shelf\", \"/rack\"})\n    String label() { return name(2); }\n"
    "    String name(int n) { return new Tag(n).text(); }\n    public void sell(int n) { audit(); }\n    record Tag(int n) { String text() { return \"t\" + n; } }\n    enum Size { SMALL, LARGE }\n}\n",
    "shop/Main.java": "package shop;\n\nclass Main {\n    public static void main(String[] args) { new Missing(); }\n}\n",
    "shop/Broken.java": "package shop;\nclass Broken {\n",
}


def test_facts_of_a_tree(spark):
    parsed = extract.parse_files(spark.createDataFrame(sorted(JAVA.items()), "path string, text string").repartition("path"), "g1").cache()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    declared, related = extract.facts(parsed, "declarations"), extract.facts(parsed, "relations")
    names = declared.select("symbol_id", "name")
    assert rows(parsed.select("path", "status")) == [("shop/Base.java", "PARSED"), ("shop/Broken.java", "PARSE_FAILED"), ("shop/Main.java", "PARSED"), ("shop/web/Shelf.java", "PARSED")]
    assert rows(declared.select("owner", "kind", "name", F.col("name_range.start_line"))) == sorted([
        ("shop", "CLASS", "Base", 3), ("shop.Base", "FIELD", "stock", 4), ("shop.Base", "METHOD", "sell", 5), ("shop.Base", "METHOD", "label", 6), ("shop", "CLASS", "Main", 3), ("shop.Main", "METHOD", "main", 4),
        ("shop.web", "CLASS", "Shelf", 6), ("shop.web.Shelf", "METHOD", "label", 8), ("shop.web.Shelf", "METHOD", "name", 9), ("shop.web.Shelf", "METHOD", "sell", 10), ("shop.web.Shelf", "RECORD", "Tag", 11), ("shop.web.Shelf.Tag", "RECORD_COMPONENT", "n", 11),
        ("shop.web.Shelf.Tag", "METHOD", "text", 11), ("shop.web.Shelf", "ENUM", "Size", 12), ("shop.web.Shelf.Size", "ENUM_CONSTANT", "SMALL", 12), ("shop.web.Shelf.Size", "ENUM_CONSTANT", "LARGE", 12)])
    found = extract.facts(parsed, "candidates").join(names, "symbol_id")
    assert rows(found.select("kind", F.col("evidence.kind"), "name", F.coalesce(F.array_join(F.try_element_at("evidence.literal_values", F.lit("value")), ","), F.lit("")))) == [("HTTP_MAPPING", "DIRECT_IMPORT", "label", "/shelf,/rack"), ("MAIN", "MAIN_SIGNATURE", "main", "")]
    assert rows(extract.facts(parsed, "folds").join(names, "symbol_id").groupBy("name").count()) == [("label", 1), ("main", 1), ("name", 1), ("sell", 2), ("text", 1)]
    targets = names.select(F.col("symbol_id").alias("target_symbol_id"), F.col("name").alias("target"))
    assert {tuple(r) for r in extract.resolved_types(parsed).join(targets, "target_symbol_id", "left").select("kind", "written_target", "target", "unresolved_reason").collect()} == {("EXTENDS", "Base", "Base", None), ("CONSTRUCT", "Tag", "Tag", None), ("CONSTRUCT", "Missing", None, "MISSING_TYPE")}
    assert rows(extract.resolved_calls(parsed).select("written_target", "resolution_state")) == [("audit", "UNRESOLVED"), ("name", "STATIC_RESOLVED"), ("text", "UNRESOLVED")]
    # a method that is seen in its own package only is not overridden from another one
    assert rows(extract.overrides(parsed).join(names, "symbol_id").select("name")) == [("sell",)]
    assert rows(related.where(F.col("rule").isNotNull()).join(names, F.col("container_symbol_id") == F.col("symbol_id")).select("kind", "rule", "name")) == [("HTTP_EVIDENCE", "spring.get-mapping", "label")]
    parsed.unpersist()


def test_written_types_are_looked_up_in_one_pass(spark):
    """A name in two wildcards and a name declared twice stay open, the nearest one decides; the options of a name are made once."""
    sources = {
        "p/A.java": "package p;\nimport q.*;\nimport r.*;\nclass A extends Near { void f() { new Two(); new Twice(); new Near(); new None(); } class Near { } }\n",
        "q/Two.java": "package q;\nclass Two { }\n", "r/Two.java": "package r;\nclass Two { }\n", "p/T.java": "package p;\nclass Twice { }\n", "p/U.java": "package p;\nclass Twice { }\n", "p/Near.java": "package p;\nclass Near { }\n",
    }
    parsed = extract.parse_files(spark.createDataFrame(sorted(sources.items()), "path string, text string"), "g")
    found = extract.resolved_types(parsed, ("CONSTRUCT",))
    names = {r["symbol_id"]: (r["owner"], r["name"]) for r in extract.facts(parsed, "declarations").collect()}
    got = {r["written_target"]: (names.get(r["target_symbol_id"]), r["unresolved_reason"]) for r in found.collect()}
    assert got == {"Two": (None, "AMBIGUOUS_TARGET"), "Twice": (None, "DUPLICATE_SOURCE_TYPE"), "Near": (("p.A", "Near"), None), "None": (None, "MISSING_TYPE")}
    # the relations are read for the options and for the result; before, a third time for the best of them
    assert found._jdf.queryExecution().optimizedPlan().toString().count("explode(relations") == 2
