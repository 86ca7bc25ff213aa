from __future__ import annotations

import gzip
import hashlib
import io
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from evalframe.llm import common, oracles, queries, urls, warc


def duck(middle: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{middle}/pages.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", ["op8_url_filter", "op9_warc"])
def test_whole_table_against_sql(spark, middle, name):
    got = queries.queries()[name](spark, middle)
    assert sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=str) == duck(middle, oracles.oracle_sql()[name])


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Org/x?y", "a.org", "/x", "org/"), ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/"), ("x://sub.example.org/en/17", "sub.example.org", "/en/17", "example.org/en/1"),
        ("http://example.org/EN/1", "example.org", "/EN/1", "org/"), ("http://notexample.com/de/", "notexample.com", "/de/", "com/de/"), ("http://com/fr/", "com", "/fr/", "com/fr/"), ("http://com/fr", "com", "/fr", None),
        ("http://xcom/fr/", "xcom", "/fr/", None), ("http://a.org?x=/y", "a.org", "", None), ("a.org/x", "", "", None), ("http://u:p@a.org:80/", "u:p@a.org:80", "/", None), ("://b.com#/de/", "b.com", "", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    r = urls.judge(spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)


def test_edges_of_the_given_pages_and_what_they_reach(spark, middle):
    """The tables' hosts have domains above them, and the walks reach some that have no page of a rule."""
    pages = common.read(spark, middle, "pages")
    edges = {(r.src, r.dst): r.n for r in urls.host_links(pages).collect()}
    hosts = Counter(r.host for r in pages.select(urls.host_of(F.col("url")).alias("host")).collect())
    want = Counter()
    for host, n in hosts.items():
        labels = host.split(".")
        for k in range(len(labels) - 2):
            want[".".join(labels[k:]), ".".join(labels[k + 1 :])] += n
    assert edges == want and len(edges) > 30
    judged = urls.judge(pages).select("host", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))
    seeded = {r.host for r in judged.where("verdict is not null").collect()}
    reached = {r.host for r in urls.standing(judged, urls.host_links(pages)).where("trust > 0 or distrust > 0").collect()}
    assert reached > seeded and "example.org" in reached - seeded


def test_what_makes_an_edge(spark):
    html = "<a href='//One.net/x'>x</a><img alt=a src=https://two.net/i.png><form\naction = \"http://three.net?q\"><a href='/local'> = //no.net <a data-to='https://one.net/again'>"
    rows = [("http://a.b.example.org/", html), ("http://127.0.0.1/", ""), ("no url", html), ("http://one.net/", "<a href='https://ONE.net/'>")]
    edges = {(r.src, r.dst): r.n for r in urls.host_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    up = {("a.b.example.org", "b.example.org"): 1, ("b.example.org", "example.org"): 1}
    assert edges == {("a.b.example.org", h): 1 for h in ("one.net", "two.net", "three.net")} | up


def test_subdomains_of_a_blocked_host_and_domains_of_a_trusted_one(spark):
    rows = [(1, "http://x.com/de/", None), (2, "http://m.x.com/", None), (3, "http://www.m.x.com/", None), (4, "http://y.com/", None), (5, "http://www.z.com/fr/", None), (6, "http://z.com/", None), (7, "http://z.com/de/", None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}
    assert got[6].trust > got[6].distrust > 0


def test_trust_and_distrust_as_walked_in_python(spark):
    link = lambda *hosts: "".join(f"<a href='https://{h}/p'>x</a>" for h in hosts)
    rows = [(1, "http://good.org/", link("x.net", "y.net")), (2, "http://x.net/", link("z.net", "x.net")), (3, "http://z.net/", link("bad.com")), (4, "http://bad.com/de/", link("y.net")), (5, "http://w.net/", link("z.net", "bad.com")), (6, "http://lone.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = defaultdict(dict)
    for _, url, html in rows:
        for dst in {h.split("/")[0] for h in html.split("https://")[1:]}:
            if dst != url.split("/")[2]:
                edges[url.split("/")[2]][dst] = 1

    def walk(seeds: dict[str, float], out: dict[str, dict[str, int]]) -> dict[str, float]:
        start = {h: (1 - urls.DAMPING) * v / sum(seeds.values()) for h, v in seeds.items()}
        mass = dict(start)
        for _ in range(urls.ROUNDS):
            new = defaultdict(float, start)
            for h, m in mass.items():
                for dst, n in out.get(h, {}).items():
                    new[dst] += urls.DAMPING * m * n / sum(out[h].values())
            mass = new
        return mass

    back = defaultdict(dict)
    for a, own in edges.items():
        for b, n in own.items():
            back[b][a] = n
    trust, distrust = walk({"good.org": 1}, edges), walk({"bad.com": 1}, back)
    for r in urls.judge(pages).collect():
        assert (r.trust, r.distrust) == (pytest.approx(trust.get(r.host, 0), abs=1e-11), pytest.approx(distrust.get(r.host, 0), abs=1e-11))
        if r.rule is None:
            assert r.verdict == ("block" if distrust.get(r.host, 0) > trust.get(r.host, 0) else "allow")
    assert {r.page_id: r.verdict for r in urls.judge(pages).collect()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_verdicts_do_not_depend_on_the_size_of_scores(spark):
    """Distrust that comes through hosts with very many links is small, and still over no trust at all."""
    link = lambda *hosts: "".join(f"<a href='https://{h}/p'>x</a>" for h in hosts)
    crowd = lambda k: [(None, f"http://c{k}-{i}.net/", link(f"hop{k}.net")) for i in range(1000)]
    rows = [(1, "http://bad.com/de/", ""), *[(None, f"http://c0-{i}.net/", link("bad.com")) for i in range(1000)], (2, "http://hop1.net/", link("c0-0.net"))]
    rows += [*crowd(1), (3, "http://hop2.net/", link("c1-0.net")), *crowd(2), (4, "http://hop3.net/", link("c2-0.net")), *crowd(3), (5, "http://hop4.net/", link("c3-0.net"))]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id is not null").collect()}
    assert 0 < got[5].distrust < 5e-13 and got[5].trust == 0
    assert {k: r.verdict for k, r in got.items()} == dict.fromkeys(range(1, 6), "block")


def test_walks_go_on_after_ten_links(spark):
    link = lambda *hosts: "".join(f"<a href='https://{h}/p'>x</a>" for h in hosts)
    rows = [(None, "http://bad.com/de/", ""), *[(k, f"http://h{k}.net/", link("bad.com" if k == 1 else f"h{k - 1}.net")) for k in range(1, 31)]]
    # Trust reaches t13.net after twelve more links than distrust, and is over it.
    rows += [(None, "http://good.org/", link("t1.net")), *[(100 + k, f"http://t{k}.net/", link(f"t{k + 1}.net")) for k in range(1, 13)], (113, "http://t13.net/", link("worse.com"))]
    rows += [(None, "http://worse.com/de/", ""), *[(None, f"http://c{i}.net/", link("worse.com")) for i in range(200)]]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id is not null").collect()}
    assert {k: got[k].verdict for k in range(1, 31)} == dict.fromkeys(range(1, 31), "block")
    assert got[113].distrust > 0 and got[113].trust == pytest.approx(0.15 * 0.85**13) and got[113].verdict == "allow"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [warc.ArcRecord(f"http://a/{i}", "1.2.3.4", "20200102030405", "text/html", b"x\n" * i) for i in range(5)]
    assert list(warc.read_arc(warc.write_arc(records, version))) == records


def test_broken_archives_are_refused():
    data = warc.write_arc([warc.ArcRecord("http://a/", "0.0.0.0", "20200101000000", "text/html", b"body")], 1)
    with pytest.raises(ValueError, match="shorter than it declares"):
        list(warc.read_arc(data[:-3]))
    with pytest.raises(ValueError, match="version block"):
        list(warc.read_arc(data[data.index(b"\n\nhttp") + 2 :]))
    with pytest.raises(ValueError, match="unknown ARC version"):
        list(warc.read_arc(data.replace(b"1 0 evalframe", b"9 0 evalframe")))
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and warc.warc_date("20010203") == "2001-02-03T00:00:00Z"


def test_files_are_gzip_members_with_valid_records(spark, small, tmp_path):
    pages = common.read(spark, small, "pages")
    warc.write_arcs(pages, str(tmp_path / "a"))
    assert warc.convert_files(warc.binary_files(spark, str(tmp_path / "a")), str(tmp_path / "w")).count() == 0
    seen = 0
    for file in Path(tmp_path / "w").glob("part-*"):
        stream = io.BytesIO(gzip.decompress(file.read_bytes()))
        while line := stream.readline():
            assert line == b"WARC/1.1\r\n"
            head = {}
            while (line := stream.readline()) != b"\r\n":
                k, _, v = line.decode().strip().partition(": ")
                head[k] = v
            block = stream.read(int(head["Content-Length"]))
            assert stream.read(4) == b"\r\n\r\n" and head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            if head["WARC-Type"] == "response":
                assert head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest()
            seen += 1
    assert seen == pages.count()


def test_record_ids_are_those_that_revisits_name(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://a.org").alias("url"), F.repeat(F.lit("same "), 50).alias("html"))
    rows = warc.archive(pages).collect()
    assert [r.page_id for r in rows if r.record_type == "response"] == [0] and {r.refers_to for r in rows if r.record_type == "revisit"} == {0}
    assert len({r.record_id for r in rows}) == 40 and {r.date for r in rows} == {"2000-01-01T00:00:00Z"}


def test_a_record_that_does_not_parse_is_reported_and_the_next_one_found():
    records = [warc.ArcRecord(f"http://a/{i} b", "1.2.3.4", "20200102030405", "text/html", b"line\n" * (i + 1)) for i in range(6)]
    for version in (1, 2):
        data = warc.write_arc(records, version)
        longer = data.replace(f" {len(records[2].block)}\nline".encode(), b" 99999\nline")
        wordy = longer.replace(b"http://a/4 b 1.2.3.4 20200102030405", b"http://a/4 b 1.2.3.4 not-a-date-or-length")
        assert wordy.count(b"\n") == data.count(b"\n")
        got = list(warc.scan_arc(wordy.replace(f" {len(records[4].block)}\nline".encode(), b" many\nline")))
        assert [r.url for _, r, _ in got if r] == [records[i].url for i in (0, 1, 3, 5)]
        assert [e for _, _, e in got if e][0] == "an ARC record is shorter than it declares" and sum(e is not None for _, _, e in got) == 2
    assert [e for _, _, e in warc.scan_arc(b"junk")] == ["an ARC header line does not end"] and list(warc.scan_arc(b"")) == [] == list(warc.scan_arc(b"\n\r\n"))
    assert [r.url for _, r, _ in warc.scan_arc(warc.write_arc(records[:1], 1) + warc.write_arc(records[1:2], 2)) if r] == ["http://a/0 b", "http://a/1 b"]


def test_broken_gzip_members_are_left_out():
    parts = [gzip.compress(f"part {i} ".encode() * 5000, mtime=0) for i in range(4)]
    bad = bytearray(parts[1])
    bad[20] ^= 255
    plain, broken = warc.unpacked(parts[0] + bytes(bad) + b"\0\0" + parts[2] + parts[3][:-6])
    assert plain == b"".join(gzip.decompress(parts[i]) for i in (0, 2)) and [at for at, _ in broken][0] == len(parts[0])
    assert warc.unpacked(b"plain") == (b"plain", []) and warc.unpacked(b"".join(parts))[0] == b"".join(map(gzip.decompress, parts))


def test_real_archives_of_both_versions(spark, tmp_path):
    """Plain and gzipped files, one of them damaged, with a payload that both have."""
    same = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + bytes(range(256)) * 2
    one = [warc.ArcRecord("http://a.org/1", "1.2.3.4", "20010203040506", "text/html", same), warc.ArcRecord("http://a.org/2", "1.2.3.4", "20020203040506", "image/gif", b"HTTP/1.0 200 OK\r\n\r\nGIF")]
    two = [warc.ArcRecord("http://b.org/1", "1.2.3.4", "19990203040506", "text/html", same), warc.ArcRecord("http://b.org/2", "1.2.3.4", "20030203", "text/plain", b"no header")]
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.arc").write_bytes(warc.write_arc(one, 1) + b"http://a.org/3 1.2.3.4 20010203040506 text/html 500\ncut")
    (source / "two.arc.gz").write_bytes(b"".join(map(gzip.compress, warc.arc_parts(two, 2))))
    (source / "empty.arc").write_bytes(b"")
    bad = warc.convert_files(spark.read.format("binaryFile").load(str(source)), str(tmp_path / "out")).collect()
    assert [(r.path.rpartition("/")[2], r.error) for r in bad] == [("one.arc", "an ARC record is shorter than it declares")]
    got = {r.target_uri: r for r in warc.read_archives(warc.binary_files(spark, str(tmp_path / "out")), "string").collect()}
    assert {k: (r.record_type, r.payload_bytes) for k, r in got.items() if r.record_type == "response"} == {"http://a.org/2": ("response", 3), "http://b.org/1": ("response", 512), "http://b.org/2": ("response", 0)}
    first, again = got["http://b.org/1"], got["http://a.org/1"]
    assert again.record_type == "revisit" and again.payload_digest == first.payload_digest == hashlib.sha256(bytes(range(256)) * 2).hexdigest()
    assert again.refers_to.startswith("19990203040506 http://b.org/1 two.arc.gz:") and got["http://b.org/2"].date == "2003-02-03T00:00:00Z"


def test_files_are_cut_by_bytes_and_many_repeated_payloads_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 3_000)
    monkeypatch.setattr(warc, "FILE_CHUNKS", 2)
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    page = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sha2(F.concat_ws("|", k, F.col("id") % 50).cast("binary"), 256)))
    pages = spark.range(0, 200, 1, 2).select(F.col("id").alias("page_id"), F.lit("http://a.org").alias("url"), page.alias("html"))
    warc.write_arcs(pages, str(tmp_path / "a"))
    records = warc.read_arcs(warc.binary_files(spark, str(tmp_path / "a")))
    firsts = warc.first_pages(records.select(F.col("page_id").cast("long").alias("page_id"), "payload_digest", "payload_bytes"))
    warc.write_warcs(records, firsts, str(tmp_path / "w"))
    for folder in ("a", "w"):
        sizes = [f.stat().st_size for f in Path(tmp_path / folder).glob("part-*")]
        assert len(sizes) > 10 and max(sizes) < 2 * (3_000 + 3_500)
    got = warc.read_archives(warc.binary_files(spark, str(tmp_path / "w"))).collect()
    assert sorted((r.page_id, r.refers_to) for r in got) == [(i, None if i < 50 else i % 50) for i in range(200)]


def test_bytes_that_are_no_text_are_written_as_they_are(spark, tmp_path):
    """What the writer of archives rests on."""
    raw = [bytes([a, b]) for a in range(0, 256, 5) for b in (0, 10, 13, 127, 128, 255)]
    warc._write_chunks(spark.createDataFrame([(x,) for x in raw], "value binary").coalesce(1), str(tmp_path / "o"))
    files = sorted(Path(tmp_path / "o").glob("part-*"))
    assert b"".join(f.read_bytes() for f in files) == b"".join(x + warc.EMPTY_MEMBER for x in raw)
