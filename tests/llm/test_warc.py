import duckdb
import pandas as pd

from quillstone.llm import warc

PAGES = [(i, f"http://x/{i}", f"<p>page {i} é</p>" * (i % 5)) for i in range(700)] + [(None, None, None), (7, "", ""), (7, "", ""), (900, "u", "x" * 50_000)]
PAGES[97] = (97, "", "abécd")  # its damage makes it shorter
SCHEMA = "page_id long, url string, html string, n int, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "h") for r in rows], SCHEMA)


def test_same_as_sql(spark):
    pages = frame(spark, [p for p in PAGES if p[0] != 7])
    found = warc.audit(pages, warc.with_damage(pages)).select("page_id", "file", "offset", "length", "sha256", "replica_sha256", "status").collect()
    db = duckdb.connect()
    db.register("pages", pd.DataFrame([p for p in PAGES if p[0] != 7], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = db.execute(warc.OP7_SQL).fetchall()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert {r.page_id for r in found if r.status == "damaged"} == {i for i in range(0, 700, 97) if i % 5}
    assert "moved" in {r.status for r in found}


def test_missing_extra_and_empty(spark):
    short, whole = frame(spark, PAGES[:300]), frame(spark, PAGES[:310])
    status = [r.status for r in warc.audit(whole, short).collect()]
    assert status.count("missing") == 10 and status.count("intact") == 300
    assert [r.status for r in warc.audit(short, whole).collect()].count("extra") == 10
    same = warc.audit(frame(spark, PAGES), frame(spark, PAGES[::-1])).collect()
    assert {r.status for r in same} == {"intact"} and len(same) == len(PAGES)
    assert warc.audit(frame(spark, []), frame(spark, [])).collect() == []
    assert [r.status for r in warc.audit(frame(spark, PAGES[:1]), frame(spark, [])).collect()] == ["missing"]


def test_files_hold_what_the_leaves_say(spark, tmp_path):
    pages = frame(spark, PAGES)
    warc.write_warc(pages, f"{tmp_path}/w")
    back = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert sorted([(r.page_id, r.url, r.html) for r in back], key=str) == sorted([(i, u or "", h or "") for i, u, h in PAGES], key=str)
    at = {(r.file, r.offset, r.length, r.page_id) for r in back}
    assert at == {(r.file, r.offset, r.length, r.page_id) for r in warc.leaves(pages).collect()}


def test_lost_and_gained_records_in_the_middle(spark):
    pages = [(2 * i, f"http://x/{i}", f"<p>page {i}</p>") for i in range(700)]
    lost, gained, hurt = pages[300], (801, "new", "new"), pages[500]
    other = [(i, u, h.upper()) if i == hurt[0] else (i, u, h) for i, u, h in pages if i != lost[0]] + [gained]
    found = {r.page_id: r for r in warc.audit(frame(spark, pages), frame(spark, other)).collect()}
    assert len(found) == 701
    assert {i: r.status for i, r in found.items() if r.status not in ("intact", "moved")} == {600: "missing", 801: "extra", 1000: "damaged"}
    assert {i for i, r in found.items() if r.status == "moved"} == {i for i, *_ in pages[301:512]} - {1000}
    assert (found[600].replica_sha256, found[801].sha256) == (None, None) and found[801].replica_sha256


def test_lost_record_among_equal_ids(spark):
    pages = [(None, "u", c) for c in "abc"] + [(7, "u", c) for c in "abcdd"] + [(8, "u", "x")]
    for gone in (0, 4, 6):
        status = sorted((r.page_id, r.status) for r in warc.audit(frame(spark, pages), frame(spark, pages[:gone] + pages[gone + 1 :])).where("status NOT IN ('intact', 'moved')").collect())
        assert status == [(pages[gone][0], "missing")]


def test_only_records_below_differing_nodes_are_compared(spark):
    pages = [(i, f"http://x/{i}", f"<p>page {i}</p>") for i in range(6000)]
    lost, hurt, gained = pages[1000], pages[3000], (90_000, "new", "new")
    other = [(i, u, "#" + h if i == hurt[0] else h) for i, u, h in pages if i != lost[0]] + [gained]
    ours, theirs = warc._ordered(frame(spark, pages), "a"), warc._ordered(frame(spark, other), "b")
    a, b = (x.collect() for x in warc.suspect_records(ours, theirs))
    assert len(a) == 2 * warc.BUCKET and len(b) == 2 * warc.BUCKET - 1 + 1
    assert {r.page_id // warc.BUCKET for r in a} == {1000 // warc.BUCKET, 3000 // warc.BUCKET}
    same = warc.suspect_records(ours, warc._ordered(frame(spark, pages[::-1]), "c"))
    assert [x.count() for x in same] == [0, 0]
    found = {r.page_id: r.status for r in warc.audit(frame(spark, pages), frame(spark, other)).collect()}
    assert {i: s for i, s in found.items() if s not in ("intact", "moved")} == {1000: "missing", 3000: "damaged", 90_000: "extra"}


def test_line_ends_in_urls_and_negative_ids(spark, tmp_path):
    pages = [(-5, "http://x/\r\n\r\nContent-Length: 3", "body"), (-300, "a\nb", "x"), (1 << 40, "u", "y")]
    warc.write_warc(frame(spark, pages), f"{tmp_path}/w")
    back = {r.page_id: (r.url, r.html) for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert back == {-5: ("http://x/%0D%0A%0D%0AContent-Length: 3", "body"), -300: ("a%0Ab", "x"), 1 << 40: ("u", "y")}
    found = {r.page_id: r.status for r in warc.audit(frame(spark, pages), frame(spark, pages[:2])).collect()}
    assert found == {-5: "intact", -300: "intact", 1 << 40: "missing"}


def test_many_records_of_one_page(spark):
    pages = [(7, "u", str(i % 400)) for i in range(1500)] + [(None, "u", str(i)) for i in range(400)]
    found = warc.audit(frame(spark, pages), frame(spark, pages[1:] + [(7, "u", "new")])).where("status NOT IN ('intact', 'moved')").collect()
    assert [(r.page_id, r.status) for r in found] == [(7, "damaged")]  # matched by rank with the one that came in its place
