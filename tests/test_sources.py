import gzip
import hashlib
import json
import resource
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chronowatt.sources import contracts, fingerprints as fp, readers, sinks, streams, xml_series


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def gz(path, text, mtime=0):
    with open(path, "wb") as f, gzip.GzipFile(fileobj=f, mode="wb", mtime=mtime) as g:
        g.write(text.encode())
    return str(path)


# ---- readers -------------------------------------------------------------------------------------------


def test_semicolon_csv_with_declared_types(spark, tmp_path):
    p = write(tmp_path / "a.csv", "k;v\nx;1.5\ny;\n")
    rows = readers.read_csv(spark, p, "k string, v double").collect()
    assert [tuple(r) for r in rows] == [("x", 1.5), ("y", None)]
    bad = write(tmp_path / "b.csv", "k;v\nx;oops\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, bad, "k string, v double").collect()
    other = write(tmp_path / "c.csv", "k;w\nx;1\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, other, "k string, v double").collect()


def test_label_stays_text_in_any_session_zone(spark, tmp_path, session_zone):
    p = write(tmp_path / "a.csv", "date_heure;v\n2024-07-01T00:00:00+00:00;1\n")
    assert readers.read_csv_named(spark, p, {"date_heure": "string", "v": "double"}).first()[0] == "2024-07-01T00:00:00+00:00"


def test_quoted_header_is_found_by_name(spark, tmp_path):
    p = write(tmp_path / "a.csv", '"Polluant";"valeur";"x"\nO3;1,5;\nNO2;2;\n')
    assert readers.read_csv_named(spark, p, {"Polluant": "string"}).count() == 2


def test_ragged_csv_with_byte_order_mark(spark, tmp_path):
    p = write(tmp_path / "a.csv", "﻿territoire,mois,duree_h,taux_pct\nCorse,2018-01,0\nCorse,2019-01,3.5,1.25\n")
    rows = readers.read_csv_ragged(spark, p, "territoire string, mois string, duree_h double, taux_pct double").collect()
    assert [tuple(r) for r in rows] == [("Corse", "2018-01", 0.0, None), ("Corse", "2019-01", 3.5, 1.25)]


def test_union_by_name_of_gz_files(spark, tmp_path):
    a = gz(tmp_path / "a.csv.gz", "A;B;X\n1;2;junk\n")
    b = gz(tmp_path / "b.csv.gz", "B;C\n3;4\n")
    got = readers.read_csv_union_by_name(spark, [a, b], columns=["A", "B", "C"])
    assert sorted(map(tuple, got.select("A", "B", "C").collect()), key=str) == [("1", "2", None), (None, "3", "4")]
    with pytest.raises(ValueError, match="D"):
        readers.read_csv_union_by_name(spark, [a, b], columns=["A", "D"])


def test_parquet_merge_schema(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "p" / "x=1"))
    spark.createDataFrame([(3, 4)], "a int, c int").write.parquet(str(tmp_path / "p" / "x=2"))
    got = readers.read_parquet_union(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, got.select("a", "b", "c").collect())) == [(1, 2, None), (3, None, 4)]


# ---- fingerprints --------------------------------------------------------------------------------------

XML = '<?xml version="1.0"?><D xmlns="urn:x"><mRID>{0}</mRID><createdDateTime>{1}</createdDateTime><TS><mRID>{2}</mRID><q>{3}</q></TS></D>'
IGNORE = ["D/mRID", "D/createdDateTime"]


def hashes(spark, folder, rules):
    schema = "file string, ignore_xml array<string>, decompressed boolean"
    found = fp.fingerprints(fp.files(spark, str(folder)), spark.createDataFrame(rules, schema))
    return {r.file: (r.sha256, r.error) for r in found.collect()}


def test_fingerprint_rules(spark, tmp_path):
    write(tmp_path / "raw.csv", "a;b\n")
    gz(tmp_path / "a.gz", "same", mtime=1)
    gz(tmp_path / "b.gz", "same", mtime=2)
    for name, args in {"x1": ("1", "t1", "m", 5), "x2": ("2", "t2", "m", 5), "x3": ("1", "t1", "n", 5), "x4": ("1", "t1", "m", 6)}.items():
        write(tmp_path / f"{name}.xml", XML.format(*args))
    write(tmp_path / "bad.xml", "<D><oops>")
    (tmp_path / "cut.gz").write_bytes((tmp_path / "a.gz").read_bytes()[:-6])
    rules = [("a.gz", None, True), ("b.gz", None, True), ("cut.gz", None, True), ("bad.xml", IGNORE, False)]
    rules += [(f"x{i}.xml", IGNORE, False) for i in (1, 2, 3, 4)]
    got = hashes(spark, tmp_path, rules)
    assert got["raw.csv"][0] == hashlib.sha256(b"a;b\n").hexdigest()
    assert got["a.gz"][0] == got["b.gz"][0] == hashlib.sha256(b"same").hexdigest()
    assert got["x1.xml"][0] == got["x2.xml"][0]  # only the envelope differs
    assert got["x3.xml"][0] != got["x1.xml"][0]  # a nested mRID is data
    assert got["x4.xml"][0] != got["x1.xml"][0]
    assert got["bad.xml"][0] is None and "ExpatError" in got["bad.xml"][1]
    assert got["cut.gz"][0] is None and got["cut.gz"][1]
    without_rule = hashes(spark, tmp_path, [("none", None, False)])
    assert without_rule["a.gz"][0] != without_rule["b.gz"][0]


def test_verify_refuses_changed_and_missing(spark, tmp_path):
    write(tmp_path / "a.csv", "1")
    found = fp.fingerprints(fp.files(spark, str(tmp_path)), spark.createDataFrame([], "file string, ignore_xml array<string>, decompressed boolean"))
    good = hashlib.sha256(b"1").hexdigest()
    fp.verify(found, spark.createDataFrame([("a.csv", good)], "file string, sha256 string"))
    for rows in ([("a.csv", "0" * 64)], [("b.csv", good)], [("a.csv", None)]):
        with pytest.raises(fp.FingerprintMismatch):
            fp.verify(found, spark.createDataFrame(rows, "file string, sha256 string"))


# ---- contracts -----------------------------------------------------------------------------------------


def test_source_contracts(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").coalesce(1).write.parquet(str(tmp_path / "pq"))
    part = next((tmp_path / "pq").glob("*.parquet")).read_bytes()
    f = tmp_path / "files"
    f.mkdir()
    (f / "ok.parquet").write_bytes(part)
    (f / "cut.parquet").write_bytes(part[:-3])
    (f / "tiny.parquet").write_bytes(b"PAR1")
    write(f / "ok.csv", '﻿"Polluant";"valeur"\nO3;1\n')
    write(f / "missing.csv", "Polluant;autre\n")
    write(f / "flat.csv", "not a table\n")
    write(f / "page.csv", "<!DOCTYPE html><html></html>")
    write(f / "typed.csv", "Polluant;valeur\n")
    write(f / "ok.json", '{"features": []}')
    write(f / "rootless.json", '{"other": 1}')
    write(f / "bad.json", "{oops")
    write(f / "ok.xml", '<?xml version="1.0"?>\n<ns:Doc xmlns:ns="urn:x"><a/></ns:Doc>')
    write(f / "ack.xml", "<Acknowledgement><a/></Acknowledgement>")
    write(f / "bomb.xml", '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><Doc/>')
    cols = ["Polluant", "valeur"]
    rows = [
        ("ok.csv", "csv", ";", cols, None, "text/csv"), ("missing.csv", "csv", ";", cols, None, None),
        ("flat.csv", "csv", ";", cols, None, None), ("page.csv", "csv", ";", cols, None, None),
        ("typed.csv", "csv", ";", cols, None, "text/html; charset=utf-8"),
        ("ok.json", "geojson", None, None, "features", None), ("rootless.json", "json", None, None, "features", None),
        ("bad.json", "json", None, None, "features", None), ("ok.parquet", "parquet", None, None, None, None),
        ("cut.parquet", "parquet", None, None, None, None), ("tiny.parquet", "parquet", None, None, None, None),
        ("ok.xml", "xml", None, None, "Doc", None), ("ack.xml", "xml", None, None, "Doc", None),
        ("bomb.xml", "xml", None, None, "Doc", None), ("absent.csv", "csv", ";", cols, None, None),
    ]
    found = contracts.violations(fp.files(spark, str(f)), spark.createDataFrame(rows, contracts.CONTRACT))
    got = {r.file: r.problem for r in found.collect()}
    assert not {n for n in got if n.startswith("ok.")}, got
    assert got["missing.csv"] == "missing columns: valeur"
    assert got["flat.csv"].startswith("header is not tabular")
    assert got["page.csv"] == got["typed.csv"] == "web page instead of data"
    assert got["rootless.json"] == "missing root key: features" and got["bad.json"] == "invalid JSON"
    assert "magic" in got["cut.parquet"] and "short" in got["tiny.parquet"]
    assert got["ack.xml"] == "unexpected root: Acknowledgement"
    assert got["bomb.xml"] == "XML with internal entities"
    assert got["absent.csv"] == "missing file"
    assert set(got) == {r[0] for r in rows} - {"ok.csv", "ok.json", "ok.parquet", "ok.xml"}


def test_schema_only_contracts(spark, tmp_path):
    a = gz(tmp_path / "a.csv.gz", "A;B\n1;2\n")
    assert contracts.gzip_header_problems(spark, a, ";", ["A"]) == []
    assert contracts.gzip_header_problems(spark, a, ";", ["A", "Z"]) == ["missing columns: Z"]
    assert contracts.gzip_header_problems(spark, a, "|", ["A"])[0].startswith("header")
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "p"))
    assert contracts.parquet_column_problems(spark, str(tmp_path / "p"), ["a", "b"]) == ["missing columns: b"]


def test_contracts_judge_whole_headers_and_prologs(spark, tmp_path):
    names = [f"column_{i:06d}" for i in range(8_000)]
    long = "<!-- " + "words of a comment > " * 6_000 + "-->"
    write(tmp_path / "wide.csv", ";".join(names) + "\n1\n")
    write(tmp_path / "comment.xml", f'<?xml version="1.0"?>{long}<Doc/>')
    write(tmp_path / "doctype.xml", f'<?xml version="1.0"?><!DOCTYPE Doc SYSTEM "d.dtd">{long}<Doc/>')
    write(tmp_path / "subset.xml", "<!DOCTYPE Doc [<!ELEMENT Doc ANY>]><Doc/>")
    write(tmp_path / "late.xml", f'{long}<!DOCTYPE Doc [<!ENTITY a "]">]><Doc/>')
    write(tmp_path / "said.xml", "<!-- no <!ENTITY here --><Doc>&lt;!ENTITY</Doc>")
    write(tmp_path / "broken.xml", "no markup")
    rows = [("wide.csv", "csv", ";", [names[-1]], None, None)]
    rows += [(f"{n}.xml", "xml", None, None, "Doc", None) for n in ("comment", "doctype", "subset", "late", "said", "broken")]
    found = contracts.violations(fp.files(spark, str(tmp_path)), spark.createDataFrame(rows, contracts.CONTRACT))
    assert {r.file: r.problem for r in found.collect()} == {"late.xml": "XML with internal entities", "broken.xml": "invalid XML"}


def judged(spark, folder, rows):
    found = contracts.violations(fp.files(spark, str(folder)), spark.createDataFrame(rows, contracts.CONTRACT))
    return {r.file: r.problem for r in found.collect()}


def test_any_number_of_comments_before_the_root(spark, tmp_path):
    write(tmp_path / "many.xml", '<?xml version="1.0"?>' + "<!-- c -->\n" * 100_000 + "<Doc/>")
    write(tmp_path / "other.xml", "<!-- c -->" * 100_000 + "<Ack/>")
    write(tmp_path / "none.xml", "<!-- c -->" * 100_000)
    rows = [(n, "xml", None, None, "Doc", None) for n in ("many.xml", "other.xml", "none.xml")]
    assert judged(spark, tmp_path, rows) == {"other.xml": "unexpected root: Ack", "none.xml": "invalid XML"}


def test_gzip_is_read_to_its_end(spark, tmp_path):
    body = "A;B\n" + "1;2\n" * 400_000
    whole = Path(gz(tmp_path / "ok.csv.gz", body)).read_bytes()
    second = Path(gz(tmp_path / "two.csv.gz", "A;B\n1;2\n")).read_bytes()
    (tmp_path / "two.csv.gz").write_bytes(second + whole + b"\0" * 512)
    (tmp_path / "cut.csv.gz").write_bytes(whole[:-5])
    (tmp_path / "member.csv.gz").write_bytes(second + whole[: len(whole) // 2])
    (tmp_path / "crc.csv.gz").write_bytes(whole[:-8] + b"\1\2\3\4" + whole[-4:])
    (tmp_path / "empty.csv.gz").write_bytes(b"")
    (tmp_path / "plain.csv.gz").write_bytes(b"A;B\n1;2\n")
    names = ("ok", "two", "cut", "member", "crc", "empty", "plain")
    got = judged(spark, tmp_path, [(f"{n}.csv.gz", "csv.gz", ";", ["A", "B"], None, None) for n in names])
    assert set(got) == {"cut.csv.gz", "member.csv.gz", "crc.csv.gz", "empty.csv.gz", "plain.csv.gz"}
    # Spark lists no empty files
    assert got.pop("empty.csv.gz") == "missing file"
    assert all(p.startswith("gzip: ") for p in got.values())
    assert "ends within a member" in got["cut.csv.gz"] and "ends within a member" in got["member.csv.gz"]
    # the same pass certifies the content
    rules = spark.createDataFrame([("two.csv.gz", None, True), ("crc.csv.gz", None, True)], "file string, ignore_xml array<string>, decompressed boolean")
    found = {r.file: r for r in fp.inspected(fp.files(spark, str(tmp_path)), rules).collect()}
    assert found["two.csv.gz"].sha256 == hashlib.sha256(b"A;B\n1;2\n" + body.encode()).hexdigest()
    assert found["crc.csv.gz"].sha256 is None and "incorrect data check" in found["crc.csv.gz"].error


def test_file_beyond_two_gigabytes_in_bounded_memory(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    want, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(block)
    rules = spark.createDataFrame([], "file string, ignore_xml array<string>, decompressed boolean")
    (row,) = fp.fingerprints(fp.files(spark, str(tmp_path)), rules).collect()
    assert (row.sha256, row.error) == (want.hexdigest(), None)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with streams.opened(f"file:{tmp_path}/big.bin") as f:
        assert streams.through(f, [streams.Start(), streams.Ends()]) == [None, None]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64_000


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_streams_do_not_depend_on_the_blocks(block):
    def fed(consumer, data):
        for i in range(0, len(data), block):
            consumer.feed(data[i : i + block])
        consumer.close()
        return consumer

    xml = XML.format("é" * 50, "t", "m", "x" * 30_000).encode()
    assert fed(streams.XmlDigest(IGNORE), xml).result() == fp.canonical_xml(xml, IGNORE)
    assert fp.canonical_xml(xml.replace(b"<q>x", b"<q><!-- c -->x"), IGNORE) == fp.canonical_xml(xml, IGNORE)
    assert fp.canonical_xml(b"<a>bc<d/></a>", []) != fp.canonical_xml(b"<a>b<d/>c</a>", [])
    packed = gzip.compress(b"abc" * 5_000) + gzip.compress(b"") + b"\0" + gzip.compress(b"tail")
    assert fed(streams.Gunzip(digest := streams.Digest()), packed) and digest.result() == hashlib.sha256(b"abc" * 5_000 + b"tail").hexdigest()
    assert fed(streams.Start(), b"\xef\xbb\xbf \n <!DocType HTML>").is_page() and not fed(streams.Start(), b"a <html").is_page()
    ends = fed(streams.Ends(), b"PAR1xxPAR1")
    assert (ends.size, ends.first, ends.last) == (10, b"PAR1", b"PAR1")
    assert fed(streams.Header(), '\ufeff"a" ;b\r\nc'.encode()).names(";") == ('"a" ;b', ["a", "b"])
    root = fed(streams.Root(), b"<?xml version='1.0'?><!DOCTYPE d [<!ELEMENT d ANY>]><n:d xmlns:n='u'><broken")
    assert (root.root, root.entities, root.broken) == ("d", False, False)


_VALUES = st.recursive(
    st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.integers() | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=5), inner, max_size=4),
    max_leaves=12,
)


def fed_json(text, wanted, block):
    found, data = streams.Json(wanted), text.encode("utf-8", "surrogatepass")
    for i in range(0, len(data), block):
        found.feed(data[i : i + block])
    found.close()
    return found


@settings(max_examples=200, deadline=None)
@given(_VALUES, st.integers(1, 9), st.booleans(), st.integers(0, 40), st.sampled_from(list('{}[],:"\\0-.x ')))
def test_json_is_judged_as_the_library_does(value, block, pretty, at, mark):
    text = json.dumps(value, indent=1 if pretty else None, ensure_ascii=pretty)
    broken = text[:at] + mark + text[at:]
    for t in (text, broken, text[: at or 1], text + text):
        try:
            known, valid = json.loads(t), True
        except ValueError:
            known, valid = None, False
        got = fed_json(t, "a", block)
        assert got.valid == valid, t
        if valid:
            assert got.found == (isinstance(known, dict) and "a" in known)


def test_json_with_a_long_text_and_odd_ends(spark, tmp_path):
    assert fed_json('{"a": "' + "x" * 300_000 + '", "features": []}', "features", 1 << 12).found
    assert not fed_json("", None, 1).valid and not fed_json("1 2", None, 1).valid and fed_json(" 12 ", None, 1).valid
    assert not streams_json_of_bytes(b"\"\xff\"").valid and fed_json("\ufeff[]", None, 1).valid


def streams_json_of_bytes(data):
    found = streams.Json()
    found.feed(data)
    found.close()
    return found


def test_parquet_columns_and_unknown_formats(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").coalesce(1).write.parquet(str(tmp_path / "pq"))
    part = next((tmp_path / "pq").glob("*.parquet")).read_bytes()
    f = tmp_path / "files"
    f.mkdir()
    (f / "p.parquet").write_bytes(part)
    write(f / "notes.txt", "<html>")
    write(f / "free.txt", "anything")
    rows = [("p.parquet", "parquet", None, ["b", "z"], None, None), ("notes.txt", "txt", None, None, None, None), ("free.txt", "txt", None, None, None, None)]
    assert judged(spark, f, rows) == {"p.parquet": "missing columns: z", "notes.txt": "web page instead of data"}
    # bytes that come from a store that executors can't open
    held = fp.files(spark, str(f)).drop("content").join(spark.createDataFrame([("p.parquet", bytearray(part))], "file string, content binary"), "file")
    (row,) = fp.inspected(held, contracts=spark.createDataFrame(rows[:1], contracts.CONTRACT)).collect()
    assert row.sha256 == hashlib.sha256(part).hexdigest() and row.problem == "missing columns: z"


# ---- XML documents -------------------------------------------------------------------------------------


def period(start, end, resolution, points):
    body = "".join(f"<Point><position>{p}</position><quantity>{q}</quantity></Point>" for p, q in points)
    return f"<Period><timeInterval><start>{start}</start><end>{end}</end></timeInterval><resolution>{resolution}</resolution>{body}</Period>"


def document(*series, root="GL_MarketDocument"):
    return f'<?xml version="1.0"?><{root} xmlns="urn:x"><mRID>d</mRID>{"".join(series)}</{root}>'


def time_series(direction, code, *periods):
    zone = f'<{direction} codingScheme="A01">10Y</{direction}>' if direction else ""
    psr = f"<MktPSRType><psrType>{code}</psrType></MktPSRType>" if code else ""
    return f"<TimeSeries><mRID>1</mRID>{zone}{psr}{''.join(periods)}</TimeSeries>"


IN, OUT = "inBiddingZone_Domain.mRID", "outBiddingZone_Domain.mRID"
DAY = ("2024-01-01T00:00Z", "2024-01-01T02:00Z")


@pytest.mark.parametrize("value", [0, 80])
def test_carried_to_the_end_of_the_period(spark, tmp_path, value, session_zone):
    p = write(tmp_path / "d.xml", document(time_series(IN, "B16", period(*DAY, "PT15M", [(1, value)]))))
    got = xml_series.generation_hours(xml_series.read_time_series(spark, p)).collect()
    assert sorted((str(r.date_heure), r.code, r.mw) for r in got) == [
        ("2024-01-01 00:00:00", "B16", float(value)), ("2024-01-01 01:00:00", "B16", float(value)),
    ]


def test_first_position_is_required(spark, tmp_path):
    p = write(tmp_path / "d.xml", document(time_series(IN, "B16", period(*DAY, "PT15M", [(2, 5)]))))
    with pytest.raises(Exception, match="first position"):
        xml_series.generation_hours(xml_series.read_time_series(spark, p)).collect()


def test_directions_resolutions_and_periods(spark, tmp_path):
    docs = document(
        time_series(IN, "B16", period(*DAY, "PT60M", [(1, 10), (2, 30)]), period("2024-01-01T02:00Z", "2024-01-01T03:00Z", "PT15M", [(1, 4), (3, 8)])),
        time_series(OUT, "B10", period(*DAY, "PT60M", [(1, 99)])),
        time_series(IN, "B16", period("2024-01-01T03:00Z", "2024-01-01T04:00Z", "PT30M", [(1, 1), (2, 3)])),
    )
    p = write(tmp_path / "d.xml", docs)
    got = {str(r.date_heure)[11:13]: r.mw for r in xml_series.generation_hours(xml_series.read_time_series(spark, p)).collect()}
    assert got == {"00": 10.0, "01": 30.0, "02": 6.0, "03": 2.0}
    load = xml_series.generation_hours(xml_series.read_time_series(spark, p), OUT, "charge").collect()
    assert {(r.code, r.mw) for r in load} == {("charge", 99.0)}


def test_unknown_resolution(spark, tmp_path):
    p = write(tmp_path / "d.xml", document(time_series(IN, "B16", period(*DAY, "P1D", [(1, 5)]))))
    with pytest.raises(Exception, match="unknown resolution"):
        xml_series.generation_hours(xml_series.read_time_series(spark, p)).collect()
    flow = write(tmp_path / "f.xml", document(time_series(None, None, period(*DAY, "PT30M", [(1, 5)])), root="Publication_MarketDocument"))
    with pytest.raises(Exception, match="unknown resolution"):
        xml_series.flow_points(xml_series.read_time_series(spark, flow)).collect()


def test_flow_leading_gap_and_undeclared(spark, tmp_path):
    text = document(
        time_series(None, None, period(*DAY, "PT15M", [(3, 7), (5, 9)]), period("2024-01-01T02:00Z", "2024-01-01T04:00Z", "PT60M", [(2, 1)])),
        root="Publication_MarketDocument",
    )
    p = write(tmp_path / "f.xml", text)
    got = xml_series.flow_points(xml_series.read_time_series(spark, p), sens=F.lit("entrant")).collect()
    rows = sorted((str(r.date_heure_utc)[11:16], r.minutes, r.mw, r.declare) for r in got)
    assert rows == [
        ("00:30", 15, 7.0, True), ("00:45", 15, 7.0, False), ("01:00", 15, 9.0, True), ("01:15", 15, 9.0, False),
        ("01:30", 15, 9.0, False), ("01:45", 15, 9.0, False), ("03:00", 60, 1.0, True),
    ]


def test_points_out_of_order_repeated_or_beyond(spark, tmp_path):
    p = write(tmp_path / "d.xml", document(time_series(None, None, period(*DAY, "PT60M", [(2, 5), (1, 3), (9, 99)]))))
    got = xml_series.flow_points(xml_series.read_time_series(spark, p)).collect()
    assert sorted(r.mw for r in got) == [3.0, 5.0]


# ---- sinks ---------------------------------------------------------------------------------------------


def test_build_roundtrip(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id")
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000
    sinks.write_ordered(df, str(tmp_path / "o"), ["k", "id"])
    files = sorted((tmp_path / "o").glob("part-*.parquet"))
    keys = [r.k for f in files for r in spark.read.parquet(str(f)).collect()]
    assert keys == list(range(1000))
