"""Archives, precedence, ancestors, overrides and inherited members."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from quarrylight.operators import extract, types
from quarrylight.sources import archives


@pytest.mark.parametrize(
    ("entry", "expected"),
    [
        ("a/b/C.class", ("a.b.C", 0, None)),
        ("a/b/C$D.class", ("a.b.C$D", 0, None)),
        ("META-INF/versions/11/a/C.class", ("a.C", 11, None)),
        ("META-INF/versions/8/a/C.class", (None, 0, "INVALID_VERSION")),
        ("META-INF/versions/x/a/C.class", (None, 0, "INVALID_VERSION")),
        ("META-INF/C.class", (None, 0, "CLASS_LAYOUT")),
        ("module-info.class", (None, 0, None)),
        ("META-INF/versions/9/module-info.class", (None, 9, None)),
        ("notes.txt", (None, 0, None)),
        ("/a/C.class", (None, 0, "UNSAFE_ENTRY")),
        ("a/../C.class", (None, 0, "UNSAFE_ENTRY")),
        ("a//C.class", (None, 0, "UNSAFE_ENTRY")),
        ("a\\C.class", (None, 0, "UNSAFE_ENTRY")),
        ("c:/C.class", (None, 0, "UNSAFE_ENTRY")),
        ("a\x01.class", (None, 0, "UNSAFE_ENTRY")),
        ("BOOT-INF/classes/C.class", (None, 0, "NESTED_LAYOUT")),
        ("lib/inner.jar", (None, 0, "NESTED_LAYOUT")),
    ],
)
def test_places_of_entries(entry, expected):
    assert archives.place(entry) == expected


def test_class_identity():
    data = archives.empty_class("a.b.Ünit", 61, 3)
    assert archives.class_identity(data) == ("a.b.Ünit", 61, 3)
    # a pool with numbers, of which the long ones take two places, before the name
    pool = b"\x05" + bytes(8) + b"\x03" + bytes(4) + b"\x01\x00\x01X" + b"\x07\x00\x04"
    assert archives.class_identity(b"\xca\xfe\xba\xbe\0\0\0\x34\0\x06" + pool + b"\0\x21\0\x05\0\0") == ("X", 52, 0)
    for bad in (b"", b"PK\3\4" * 9, data[:20], data[:9] + b"\xff" + data[10:], b"\xca\xfe\xba\xbe\0\0\0\x34\0\x02\x63"):
        with pytest.raises(archives.ClassFormat):
            archives.class_identity(bad)


def jar(path, entries, manifest=None):
    with zipfile.ZipFile(path, "w") as z:
        if manifest is not None:
            z.writestr("META-INF/MANIFEST.MF", manifest)
        for name, data in entries:
            z.writestr(name, data)


def of(name, major=52):
    return archives.empty_class(name, major)


@pytest.fixture
def folder(tmp_path):
    multi = "Manifest-Version: 1.0\r\nMulti-Rel\r\n ease: TRUE\r\n\r\n"
    jar(tmp_path / "a.jar", [("p/One.class", of("p.One")), ("META-INF/versions/9/p/One.class", of("p.One", 53)), ("META-INF/versions/21/p/One.class", of("p.One", 65)), ("META-INF/versions/22/p/One.class", of("p.One", 65)), ("META-INF/versions/17/p/Late.class", of("p.Late"))], multi)
    jar(tmp_path / "b.jar", [("p/One.class", of("p.One")), ("p/Two$In.class", of("p.Two$In")), ("META-INF/versions/11/p/Two$In.class", of("p.Two$In"))], "Manifest-Version: 1.0\n\nName: x\nMulti-Release: true\n")
    jar(tmp_path / "c.jar", [("p/Two$In.class", of("p.Two$In", 50)), ("p/Wrong.class", of("p.Other")), ("p/New.class", of("p.New", 66)), ("p/Big.class", bytes(archives.CLASS_BYTES_MOST + 1)), ("p/Text.class", b"none"), ("x/../y", b"")])
    (tmp_path / "readme.txt").write_text("no archive")
    return str(tmp_path)


def test_catalogue_of_archives(spark, folder):
    rows = archives.archive_entries(spark, "file://" + folder)
    got = {r.name: (r.binary_name, r.artifact, r.version, r.major) for r in archives.catalogue(rows).collect()}
    assert got == {"p.One": ("p.One", "a.jar", 21, 65), "p.Late": ("p.Late", "a.jar", 17, 52), "p.Two$In": ("p.Two$In", "b.jar", 0, 52), "p.Two.In": ("p.Two$In", "b.jar", 0, 52)}
    faults = {(r.entry, r.fault) for r in rows.where("fault is not null").collect()}
    assert faults == {("p/Wrong.class", "CLASS_IDENTITY"), ("p/New.class", "CLASS_LEVEL"), ("p/Big.class", "CLASS_TOO_LARGE"), ("p/Text.class", "CLASS_FORMAT"), ("x/../y", "UNSAFE_ENTRY")}


def test_conditions_reach_the_reader(spark, folder, tmp_path):
    reader = archives.ArchiveReader(folder)
    left = list(reader.pushFilters([EqualTo(("artifact_order",), 1), In(("binary_name",), ("p.One", "p.Two")), GreaterThan(("major",), 3), EqualTo(("binary_name",), "p.One")]))
    assert left == [GreaterThan(("major",), 3)]
    (part,) = reader.partitions()
    assert part.name == "b.jar" and [r["binary_name"] for b in reader.read(part) for r in b.to_pylist()] == ["p.One"]
    none = archives.ArchiveReader(folder)
    assert not list(none.pushFilters([LessThan(("artifact_order",), 0)])) and not [b for p in none.partitions() for b in none.read(p)]
    rows = archives.archive_entries(spark, folder).where((F.col("binary_name") == "p.One") & (F.col("artifact_order") > 0))
    assert [(r.artifact, r.version) for r in rows.collect()] == [("b.jar", 0)]
    empty = tmp_path / "none"
    empty.mkdir()
    assert archives.archive_entries(spark, str(empty)).count() == 0


def test_a_reader_reads_the_directory_and_what_it_returns(folder, monkeypatch):
    opened = []
    real = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(getattr(name, "filename", name)) or real(self, name, *a, **k))
    reader = archives.ArchiveReader(folder)
    assert not list(reader.pushFilters([EqualTo(("binary_name",), "p.Late"), EqualTo(("artifact_order",), 0)]))
    assert [r["version"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [17]
    assert opened == ["META-INF/MANIFEST.MF", "META-INF/versions/17/p/Late.class"]


def test_duplicate_entries_and_written_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.jar", "w") as z, pytest.warns(UserWarning):
        z.writestr("A.class", of("A"))
        z.writestr("A.class", of("A"))
    found = archives.archive_entries(spark, str(tmp_path)).collect()
    assert sorted(r.fault or "" for r in found) == ["", "DUPLICATE_ENTRY"]
    rows = [(f"x{i % 3}.jar", True, f"k/C{i}.class", f"k.C{i}", 52) for i in range(50)]
    out = f"file://{tmp_path}/out"
    archives.write_archives(spark.createDataFrame(rows, "artifact string, multi_release boolean, entry string, class_name string, major int").repartition(5), out)
    again = archives.archive_entries(spark, out)
    assert sorted((r.artifact, r.binary_name) for r in again.collect()) == sorted((a, n) for a, _, _, n, _ in rows)
    data = (tmp_path / "out" / "x0.jar").read_bytes()
    assert archives._is_multi_release(zipfile.ZipFile(io.BytesIO(data)))


def test_precedence_of_origins(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    wanted = df([(n,) for n in "abcdef"] + [("a",)], "name string")
    got = types.resolved_names(
        wanted, df([("a", "p1")], "name string, target string"), df([("a", "s1"), ("b", "s2"), ("c", "s3"), ("c", "s4")], "name string, target string"),
        df([("a", 0, "j"), ("b", 0, "j"), ("c", 0, "j"), ("d", 2, "j2"), ("d", 1, "j1"), ("e", 4, "j4")], "name string, artifact_order int, target string"))
    assert {tuple(r) for r in got.collect()} == {("a", "PLATFORM", "p1", None), ("b", "SOURCE", "s2", None), ("c", None, None, "DUPLICATE_SOURCE_TYPE"), ("d", "ARCHIVE", "j1", None), ("e", "ARCHIVE", "j4", None), ("f", None, None, "MISSING_TYPE")}


def closure(spark, kinds, edges):
    t = spark.createDataFrame(kinds, "type string, parameters array<string>")
    e = spark.createDataFrame(edges, "type string, above string, arguments array<array<string>>")
    return {(r.type, r.above): (r.distance, [" ".join(x) for x in r.arguments]) for r in types.ancestors(t, e).collect()}


def test_ancestors_bind_variables(spark):
    kinds = [("A", ["T"]), ("B", ["K", "V"]), ("C", []), ("D", ["X"]), ("R", ["Q"])]
    edges = [("B", "A", [["Map", "<", "V", ",", "K", ">"]]), ("D", "B", [["X"], ["String"]]), ("C", "D", [["List", "<", "Long", ">"]]), ("R", "A", [])]
    got = closure(spark, kinds, edges)
    assert got["C", "A"] == (3, ["Map < String , List < Long > >"]) and got["C", "B"] == (2, ["List < Long >", "String"]) and got["D", "A"] == (2, ["Map < String , X >"])
    assert got["R", "A"] == (1, []) and len(got) == 7


def test_ancestors_of_long_chains_diamonds_and_cycles(spark):
    chain = [(f"t{i}", f"t{i + 1}", [["T"]]) for i in range(37)]
    got = closure(spark, [(f"t{i}", ["T"]) for i in range(38)], chain)
    assert len(got) == 37 * 38 // 2 and got["t0", "t37"] == (37, ["T"])
    got = closure(spark, [(x, []) for x in "abcd"], [("a", "b", []), ("a", "c", []), ("b", "d", []), ("c", "d", []), ("a", "d", [])])
    assert got["a", "d"][0] == 1 and len(got) == 5
    got = closure(spark, [(x, ["T"]) for x in "abc"], [("a", "b", [["List", "<", "T", ">"]]), ("b", "a", [["T"]]), ("c", "a", [["T"]])])
    assert set(got) == {("a", "b"), ("b", "a"), ("c", "a"), ("c", "b")}
    assert closure(spark, [("a", [])], []) == {}


def parsed(spark, sources):
    return extract.parse_files(spark.createDataFrame(list(sources.items()), "path string, text string"), "g")


def found_overrides(spark, sources):
    p = parsed(spark, sources)
    d = extract.facts(p, "declarations").select("symbol_id", "name", "owner", "signature")
    o = extract.overrides(p).join(d, "symbol_id").join(d.select(F.col("symbol_id").alias("overridden_id"), F.col("owner").alias("above")), "overridden_id")
    return sorted((r.owner, r.name, r.above) for r in o.collect())


def test_overrides_with_variables_of_ancestors(spark):
    sources = {
        "k/Codec.java": "package k; public interface Codec<I, O> { O code(I in); void close(); default int size(O[] all, java.util.List<? extends I> in) { return 0; } }",
        "k/Base.java": "package k; public abstract class Base<E> implements Codec<E, java.util.Map<String, E>> { abstract E one(E e); protected Object make() { return null; } static void tool() {} private void own() {} void near() {} <Z> Z id(Z z) { return z; } }",
        "k/Leaf.java": "package k; class Leaf extends Base<Long> { public Map<String, Long> code(Long in) { return null; } public void close() {} public int size(Map<String, Long>[] all, List<? extends Long> in) { return 1; } Long one(Long e) { return e; } protected Leaf make() { return this; } static void tool() {} void own() {} void near() {} <Y> Y id(Y y) { return y; } }",
        "m/Far.java": "package m; import k.Base; class Far extends Base<String> { String code(String wrong) { return null; } public void near() {} protected int make() { return 1; } String one(String e) { return e; } <Y> String id(String y) { return y; } }",
    }
    assert found_overrides(spark, sources) == [("k.Leaf", "close", "k.Codec"), ("k.Leaf", "code", "k.Codec"), ("k.Leaf", "id", "k.Base"), ("k.Leaf", "make", "k.Base"), ("k.Leaf", "near", "k.Base"), ("k.Leaf", "one", "k.Base"), ("k.Leaf", "size", "k.Codec")]


def test_calls_reach_the_nearest_ancestor(spark):
    sources = {
        "k/Top.java": "package k; public class Top { void top(int n) {} void both(int n) {} }",
        "k/Mid.java": "package k; public class Mid extends Top implements Left, Right { void both(int n) {} }",
        "k/Left.java": "package k; public interface Left { void side(); }",
        "k/Right.java": "package k; public interface Right { void side(); }",
        "k/Low.java": "package k; public class Low extends Mid { void run(Mid other) { top(1); both(2); side(); other.top(3); this.none(); } }",
    }
    p = parsed(spark, sources)
    d = {r.symbol_id: f"{r.owner}.{r.name}" for r in extract.facts(p, "declarations").collect()}
    got = {(r.written_target, d.get(r.target_symbol_id), r.unresolved_reason) for r in extract.resolved_calls(p).collect()}
    assert got == {("top", "k.Top.top", None), ("both", "k.Mid.both", None), ("side", None, "AMBIGUOUS_TARGET"), ("none", None, "MISSING_TYPE")}


def test_rounds_of_ancestors_write_each_pair_once(spark, monkeypatch):
    """A chain with a short cut, a type with two ways up and a cycle: rounds add what is new, and distances are the shortest."""
    up = {i: [i - 1] for i in range(1, 21)} | {30: [12, 13], 31: [30, 2], 40: [41], 41: [42], 42: [40, 5]}
    kinds = spark.createDataFrame([(str(i), ["A"]) for i in {0, *up}], "type string, parameters array<string>")
    edges = spark.createDataFrame([(str(i), str(k), [["A"]]) for i, ks in up.items() for k in ks], "type string, above string, arguments array<array<string>>")
    counts = []

    def counted(df, name, written=types.written):
        out = written(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(types, "written", counted)
    got = {(r["type"], r["above"]): r["distance"] for r in types.ancestors(kinds, edges).collect()}
    expected = {}
    for i in up:
        level, distance = {i}, 0
        while level := {k for x in level for k in up.get(x, ())} - {i} - {k for t, k in expected if t == i}:
            distance += 1
            expected |= {(i, k): distance for k in level}
    assert got == {(str(i), str(k)): n for (i, k), n in expected.items()}
    assert sum(counts) == len(got) and len(counts) <= 6  # before, every round wrote all pairs again


@pytest.fixture
def joined_by_moving(spark):
    """No table is small enough to be sent to all tasks."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, kept)


def exchanges(df):
    return [line.split("Exchange ")[1] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]


def tree(spark, n=200):
    """Type k is below k // 2 and k // 3, which meet again."""
    kinds = spark.createDataFrame([(str(k), ["A", "B"]) for k in range(1, n)], "type string, parameters array<string>")
    edges = [(str(k), str(k // d), [["List", "<", "B", ">"], ["A"]]) for k in range(2, n) for d in (2, 3) if k // d]
    return kinds, spark.createDataFrame(edges, "type string, above string, arguments array<array<string>>")


def test_lists_of_tokens_as_text(spark):
    lists = [[], [[]], [["A"], []], [["List", "<", "A", ">"], ["B"]], None]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(lists)], "i int, e array<array<string>>").select("i", types._unpacked(types._packed(F.col("e"))).alias("e"))
    assert [r.e for r in rows.orderBy("i").collect()] == lists


def test_rounds_of_ancestors_move_stretches_and_new_pairs_alone(joined_by_moving, monkeypatch):
    plans = []
    real = types.written
    monkeypatch.setattr(types, "written", lambda df, name: plans.append(exchanges(getattr(df, "rows", df))) or real(df, name))
    got = types.ancestors(*tree(joined_by_moving))
    assert got.count() == got.select("type", "above").distinct().count() > 500
    assert len(plans) > 3 and all(len(p) == 2 and all("REPARTITION_BY_NUM" in x for x in p) for p in plans[1:])  # before, known pairs were moved by each round


def test_overrides_bring_names_to_the_pairs(joined_by_moving, monkeypatch):
    spark = joined_by_moving
    kinds, edges = tree(spark)
    above = types.ancestors(kinds, edges)
    of = lambda k: [["List", "<", "B", ">"]] if k % 2 else [["B"]]
    rows = [(f"{k}.m{i}", str(k), None if k % 3 else "p", f"m{i}", ["public"] if k % 5 else [], of(k), ["void"] if i else [str(k)]) for k in range(1, 200) for i in range(2)]
    methods = spark.createDataFrame(rows, "method string, type string, package string, name string, modifiers array<string>, parameters array<array<string>>, returns array<string>")
    plans = {}
    real = types.written
    monkeypatch.setattr(types, "written", lambda df, name: plans.update({name: exchanges(df)}) or real(df, name))
    got = {tuple(r) for r in types.overriding(methods, above).collect()}
    pairs = {(r["type"], r["above"]): r for r in above.collect()}
    put = lambda e, r: [x for t in e for x in (r.arguments[r.parameters.index(t)] if t in r.parameters else [t])]
    expected = {(a[0], b[0], r.distance) for a in rows for b in rows if a[3] == b[3] and (r := pairs.get((a[1], b[1]))) and (b[4] or a[2] and a[2] == b[2])
                and a[5] == [put(e, r) for e in b[5]] and (a[6] == b[6] or a[6] != ["void"] != b[6] and (a[6][0], b[6][0]) in pairs)}
    assert got == expected and len(got) > 20
    assert len(plans["met"]) == 6  # four of methods and their names, two of what meets; pairs with arguments stay where they lie


def test_members_move_no_arguments(joined_by_moving):
    spark = joined_by_moving
    above = types.ancestors(*tree(spark), bind=False)
    assert above.columns == ["type", "above", "distance"]
    assert {tuple(r) for r in above.collect()} == {tuple(r) for r in types.ancestors(*tree(spark)).select("type", "above", "distance").collect()}
    calls = spark.createDataFrame([(f"c{k}", str(k), "f", 0) for k in range(1, 200)], "call string, type string, name string, n int")
    methods = spark.createDataFrame([("2.f", "2", "f", 0), ("3.f", "3", "f", 0)], "method string, type string, name string, n int")
    got = types.members(calls, methods, above)
    found = got.where("state = 'STATIC_RESOLVED'").count()
    assert 0 < found < 199
