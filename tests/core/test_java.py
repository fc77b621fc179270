from pyspark.sql import functions as F

from quarrylight.operators.javasource import extract

SOURCE = '''package demo.shop;
import org.springframework.web.bind.annotation.GetMapping;
import demo.base.Base;
/** docs */
public class Shop extends Base implements Runnable {
    private int count = size(1), other;
    static { init(); }
    public Shop(int n) { this.count = n; }
    @GetMapping(value = {"/a", "/b"}, produces = X.Y)
    public java.util.List<String> list(String q, Map<String, Integer> m) { helper(); return new Cart(q, 1).all(); }
    void helper() { Runnable r = () -> run(); class Inner { int z; } }
    public void run() { }
    public static void main(final String[] args) { }
    enum Color { RED, GREEN { void f() { } }; int code; }
    record Pair<T>(T left, int right) { Pair { left = left; } }
    @interface Mark { String value() default "é"; }
    interface Face { void look(); }
}
'''


def test_declarations():
    p = extract("g", "demo/Shop.java", SOURCE)
    assert p.status == "PARSED", p.diagnostics
    kinds = [(d["kind"], d["name"], d["owner"]) for d in p.declarations]
    assert ("CLASS", "Shop", "demo.shop") in kinds
    for kind, name in (("FIELD", "count"), ("FIELD", "other"), ("CONSTRUCTOR", "Shop"), ("METHOD", "list"), ("METHOD", "main"), ("ENUM", "Color"), ("RECORD", "Pair"), ("ANNOTATION_TYPE", "Mark"), ("INTERFACE", "Face")):
        assert (kind, name, "demo.shop.Shop") in kinds
    for kind, name, owner in (("ENUM_CONSTANT", "RED", "Color"), ("RECORD_COMPONENT", "right", "Pair"), ("ANNOTATION_MEMBER", "value", "Mark"), ("CONSTRUCTOR", "Pair", "Pair"), ("METHOD", "look", "Face")):
        assert (kind, name, f"demo.shop.Shop.{owner}") in kinds
    assert any(k == "CLASS" and n == "Inner" and "#method:helper@" in o for k, n, o in kinds)
    data = SOURCE.encode()
    for d in p.declarations:
        r = d["name_range"]
        assert data[r["start_byte"] : r["end_byte"]].decode() == d["name"]
        assert r["start_line"] == data[: r["start_byte"]].count(b"\n") + 1
    listed = next(d for d in p.declarations if d["name"] == "list")
    assert listed["signature"] == "public java.util.List<String>list(String q, Map<String, Integer>m)" or "list(String q" in listed["signature"]
    assert len({d["symbol_id"] for d in p.declarations}) == len(p.declarations)


def test_candidates_folds_relations():
    p = extract("g", "demo/Shop.java", SOURCE)
    found = {c["kind"]: c["evidence"] for c in p.candidates}
    assert found["HTTP_MAPPING"]["literal_values"] == {"value": ["/a", "/b"]} and found["HTTP_MAPPING"]["unresolved_members"] == ["produces"]
    assert found["HTTP_MAPPING"]["kind"] == "DIRECT_IMPORT" and found["MAIN"]["kind"] == "MAIN_SIGNATURE"
    names = {d["symbol_id"]: d["name"] for d in p.declarations}
    assert {names[f["symbol_id"]] for f in p.folds} >= {"Shop", "list", "helper", "run", "main"}
    written = {(r["kind"], r["written_target"]) for r in p.relations}
    assert {("EXTENDS", "Base"), ("IMPLEMENTS", "Runnable"), ("CONSTRUCT", "Cart"), ("CALL", "helper"), ("CALL", "all"), ("CALL", "size"), ("HTTP_EVIDENCE", "org.springframework.web.bind.annotation.GetMapping")} <= written


def test_failures_have_no_facts():
    for bad in ("class A { ", "class A { void f( { } }", 'class A { String s = "x\n"; }', "class A } {"):
        p = extract("g", "A.java", bad)
        assert p.status == "PARSE_FAILED" and not p.declarations and p.diagnostics
    assert extract("g", "a.txt", "class A {}").status == "UNSUPPORTED"
    assert extract("g", "A.java", "x" * (1 << 20) + "x").status == "TOO_LARGE"
    assert extract("g", "A.java", "").status == "PARSED"


def test_framework_calls():
    source = """package q; import org.springframework.kafka.core.KafkaTemplate; import java.sql.Connection;
class Out { private final KafkaTemplate<String, String> bus; void go(Connection c, String t) { bus.send("orders", t); bus.send(t, "x"); c.prepareStatement("select 1"); other.send("a"); } }"""
    p = extract("g", "Out.java", source)
    found = [(r["rule"], r["written_target"].rpartition(".")[2], r["receiver"]) for r in p.relations if r["rule"]]
    assert found == [("spring-kafka-send", "send", "topic=orders"), ("spring-kafka-send", "send", None), ("jdbc-connection-sql", "prepareStatement", "sql=select 1")]


def test_outcomes_are_given_on_in_slices(spark, tmp_path):
    """A worker holds a slice of outcomes, not those of a whole batch; files are dealt over all cores whatever their bytes."""
    import pyarrow as pa

    from quarrylight.operators import extract
    from quarrylight.queries_java import java_files

    schema = spark.createDataFrame([], extract.SCHEMA).toArrow().schema
    paths, asked = [f"p/T{i}.java" for i in range(600)], []

    def batches():
        for at in range(0, 600, 300):
            asked.append(at)
            yield pa.RecordBatch.from_pydict({"path": paths[at : at + 300], "text": [f"class T{i} {{ }}" for i in range(at, at + 300)]})

    out = extract.parsed_batches(batches(), "g", schema)
    first = next(out)
    assert first.num_rows == extract.FILES_AT_ONCE and asked == [0]
    rest = [first, *out]
    assert [p for b in rest for p in b.column("path").to_pylist()] == paths and all(b.num_rows <= extract.FILES_AT_ONCE for b in rest)
    large = pa.RecordBatch.from_pydict({"path": paths[:4], "text": ["/*" + "x" * extract.CHARACTERS_AT_ONCE + "*/ class A { }"] * 4})
    assert [b.num_rows for b in extract.parsed_batches(iter([large]), "g", schema)] == [1] * 4
    # adaptive execution made one task of them, as they are few bytes
    spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit(1).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    ids = java_files(spark, str(tmp_path)).select(F.spark_partition_id().alias("k")).distinct()
    assert ids.count() == spark.sparkContext.defaultParallelism
