import gzip
import io
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgraph.sources import archives, articles, citations, xml_paths

DOC = '<article xmlns:x="u"><front><article-meta><article-id pub-id-type="pmid">%d</article-id></article-meta></front><body><p>%s</p></body></article>'


def tar(rows, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        folder = tarfile.TarInfo("folder.xml")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, raw in rows:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def zipped(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in rows:
            z.writestr(name, raw)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    good = lambda k, text="t": (f"a/{k}.xml", (DOC % (k, text)).encode())
    (tmp_path / "one.tar").write_bytes(tar([good(1), ("readme.txt", b"no"), ("bad.xml", b"<article><p></article>"), ("b.xml", b"<book/>"), good(2)], "w"))
    (tmp_path / "two.tar.gz").write_bytes(tar([good(3, "é" * 100_000), good(4)], "w:gz"))
    (tmp_path / "three.zip").write_bytes(zipped([good(5), ("dir/", b""), ("latin.xml", '<?xml version="1.0" encoding="ISO-8859-1"?><article><body>é</body></article>'.encode("latin-1")), ("odd.xml", b"<article>\xff</article>"), good(5)]))
    (tmp_path / "four.xml.gz").write_bytes(gzip.compress((DOC % (6, "&nbsp;&amp;")).encode()))
    (tmp_path / "five.xml").write_bytes(b'\xef\xbb\xbf<?xml version="1.0"?><!DOCTYPE article PUBLIC "-//X//DTD 1.0//EN" "http://localhost/none.dtd" [<!ENTITY a "b">]><article><body/></article>')
    (tmp_path / "cut.tar.gz").write_bytes(tar([good(7), good(8, "".join(map(str, range(100_000))))], "w:gz")[:40_000])
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "junk.tar").write_bytes(b"not an archive at all" * 100)
    return tmp_path


def rows_of(df):
    return sorted((r.archive.rpartition("/")[2], r.member or "", r.error or "", r.body or "") for r in df.collect())


def test_members_and_rejects(spark, folder):
    rows = rows_of(archives.read_archives(spark, f"file://{folder}"))
    assert [r[:3] for r in rows] == [
        ("cut.tar.gz", "", "unreadable archive"), ("cut.tar.gz", "a/7.xml", ""), ("five.xml", "five.xml", ""), ("four.xml.gz", "four.xml", ""), ("junk.tar", "", "unreadable archive"),
        ("one.tar", "a/1.xml", ""), ("one.tar", "a/2.xml", ""), ("one.tar", "b.xml", "root is book"), ("one.tar", "bad.xml", "not well formed"),
        ("three.zip", "a/5.xml", ""), ("three.zip", "a/5.xml", ""), ("three.zip", "latin.xml", ""), ("three.zip", "odd.xml", "not text"), ("two.tar.gz", "a/3.xml", ""), ("two.tar.gz", "a/4.xml", ""),
    ]
    body = {r[1]: r[3] for r in rows}
    assert body["latin.xml"] == "<body>é</body>" and body["a/3.xml"] == f"<body><p>{'é' * 100_000}</p></body>" and body["four.xml"] == "<body><p>\xa0&amp;</p></body>" and body["five.xml"] == "<body/>"
    none = spark.createDataFrame([("x", b""), ("y", None)], "path string, content binary")
    assert [r.error for r in archives.read_members(none).collect()] == ["unreadable archive"] * 2
    # files that tasks open themselves give the same
    assert rows_of(archives.read_archives(spark, f"file://{folder}", whole=5)) == rows
    good = archives.read_archives(spark, f"file://{folder}").where("error IS NULL").select(F.concat_ws("#", "archive", "member").alias("path"), "xml", "body")
    assert Counter(r.pmid for r in articles.article_fields(good).collect()) == Counter({None: 2, **{str(k): 1 for k in (1, 2, 3, 4, 6, 7)}, "5": 2})


def test_stream_goes_on_where_it_stopped(spark, folder, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")

    def run():
        query = archives.stream_archives(spark, f"file://{folder}", files_a_batch=2).writeStream.format("parquet").option("checkpointLocation", f"file://{base}/marks").option("path", f"file://{base}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return rows_of(spark.read.parquet(f"file://{base}/out"))

    first = run()
    assert first == rows_of(archives.read_archives(spark, f"file://{folder}"))
    assert run() == first
    (folder / "six.xml").write_text(DOC % (9, "new"))
    assert sorted(set(run()) - set(first)) == [("six.xml", "six.xml", "", "<body><p>new</p></body>")] and len(run()) == len(first) + 1


def test_floats_take_the_place_of_references():
    floats = '<fig id="a"><p>A <xref rid="b"/></p><fig id="in">inner</fig></fig><fig>no id</fig><table-wrap id="b"><p>B <xref rid="a"/></p></table-wrap>'
    text = f'<n:article><n:body><p><xref rid="a"/>|<xref rid="a"></xref>|<xref rid="in"/>|<xref rid="none"/>|<xref rid="a">kept</xref></p></n:body><floats-group>{floats}</floats-group><sub><body>second</body></sub></n:article>'
    root, body = archives.parsed(text)
    table = '<table-wrap id="b"><p>B <xref rid="a"/></p></table-wrap>'  # tables come after figures, so this one stays
    figure = f'<fig id="a"><p>A {table}</p><fig id="in">inner</fig></fig>'
    assert root == "article" and body == f'<n:body><p>{figure}|{figure}|<fig id="in">inner</fig>|<xref rid="none"/>|<xref rid="a">kept</xref></p></n:body>'
    assert archives.parsed("<a/>") == ("a", None) and archives.parsed('<a><body x="1>"/></a>') == ("a", '<body x="1>"/>')
    assert archives.parsed("<a><body>text/></body></a>")[1] == "<body>text/></body>" and archives.parsed("<a><body><b/></body></a>")[1] == "<body><b/></body>"


def test_malformed_records_don_t_end_the_job(spark):
    good = "<PubmedArticle><MedlineCitation><PMID>8</PMID></MedlineCitation></PubmedArticle>"
    records = spark.createDataFrame([(good, 1), (good.replace("</PMID>", ""), 2), (None, 3), ("", 4)], "xml string, error int")
    fine, bad = archives.checked(records.withColumnRenamed("error", "k"))
    assert [r.pmid for r in citations.citation_fields(fine).collect()] == ["8"]
    assert sorted((r.k, r.error) for r in bad.collect()) == [(2, "not well formed"), (3, "not well formed"), (4, "not well formed")]


def plain_paths(text):
    out = []
    bare = lambda x: x.rpartition("}")[2]
    hidden = lambda x: "math" in x.lower() or "formula" in x.lower()

    def walk(e, path):
        if hidden(bare(e.tag)):
            return
        if path:
            out.append(path)
        for k, v in e.attrib.items():
            k = bare(k)
            if not hidden(k):
                node = f"{path or bare(e.tag)} → @{k}"
                omit = k.lower() == "href" or any(x in node for x in xml_paths.WITHOUT_VALUE)
                out.append(node if omit else f"{node}={v[:512] + '…' if len(v) > 512 else v}")
        for c in e:
            walk(c, f"{path} → {bare(c.tag)}" if path else bare(c.tag))

    walk(ET.fromstring(text), "")
    return Counter(out)


def test_path_counts_equal_those_of_a_plain_parser(spark):
    texts = [
        '<article xmlns:x="u" id="1" x:lang="de"><front><p x:href="h" class="c"/><x:p class="c"><b/></x:p></front><math><p/></math><disp-formula-group><a/></disp-formula-group><sec id="s"><p id="q" mathvariant="m">t<!-- c --><?pi x?></p></sec></article>',
        f'<article><ref id="{"r" * 9}" long="{"v" * 600}"/><issue seq="4" n="{"w" * 512}"/></article>', "<mathml><a/></mathml>", "<a>" + "<b>" * 300 + "</b>" * 300 + "</a>",
    ]
    df = spark.createDataFrame([(t, 1) for t in [*texts, texts[0], "<a><b></a>", None, ""]], "xml string, n int").repartition(3)
    counts = {r.path: r.n for r in xml_paths.path_counts(df).collect()}
    assert counts == dict(sum((plain_paths(t) for t in [*texts, texts[0]]), Counter()))
    frame = xml_paths.path_counts(df)
    assert {r.path: r.n for r in xml_paths.from_lines(xml_paths.as_lines(frame)).collect()} == {p: n for p, n in counts.items() if "math" not in p and "formula" not in p}
    old = spark.createDataFrame([("(4) front → p",), ("new → path",), ("",)], "value string")
    both = {r.path: r.n for r in xml_paths.merged(frame, xml_paths.from_lines(old)).collect()}
    assert both["front → p"] == counts["front → p"] + 4 and both["new → path"] == 1
    assert {r.path for r in xml_paths.element_paths(frame).collect()} == {p for p in counts if " → @" not in p}
