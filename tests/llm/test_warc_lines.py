import hashlib
import io
import struct
import zipfile

import pytest

from quillmark.llm import line_dedup, warc
from quillmark.llm._tables import new_path

BIG = "<p>" + "word " * 400


@pytest.fixture(scope="module")
def pages():
    rows = [(1, "http://a", BIG), (2, "http://b", BIG), (9, "http://c", BIG), (9, "http://c", BIG), (3, None, "small"), (4, "u\r\nx", "small"), (5, "d", None), (6, "e", ""), (None, "f", BIG), (None, "g", BIG + "x"), (None, "h", BIG + "x"), (7, "ü", "é" * 600)]
    return [(*r, "extra") for r in rows]


def brute(rows):
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        again = len(data) >= 1000 and bool(same) and page != max(same)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_archives_round_trip(spark, pages, archive_bytes):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, digest string").repartition(2)
    manifest = warc.write_archives(df, new_path(spark, "test-warc"), archive_bytes=archive_bytes)
    rows = warc.read_archives(manifest).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == brute(pages)
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {(r[2] or "").encode() for r in pages}
    for m in manifest.collect():
        with zipfile.ZipFile(m.path) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
            assert z.namelist() == [warc.RECORDS, warc.INDEX]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(df, new_path(spark, "test-warc"))).count() == 0


def test_directory_of_plain_zip_and_of_zip64():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", b"12345")
        z.writestr("dir/b", b"")
        z.comment = b"PK, a comment"
    found = warc.directory(plain, len(plain.getvalue()))
    at, n, _ = found["a"]
    assert plain.getvalue()[at : at + n] == b"12345" and found["dir/b"][1] == 0
    wide = io.BytesIO()
    with zipfile.ZipFile(wide, "w") as z, z.open("c", "w", force_zip64=True) as f:
        f.write(b"xyz")
    at, n, _ = warc.directory(wide, len(wide.getvalue()))["c"]
    assert wide.getvalue()[at : at + n] == b"xyz"


def test_directory_reads_sizes_beyond_32_bits():
    class Sparse:
        """A ZIP64 file of 5 GB of which only the local header and the end exist."""

        def __init__(self):
            self.out, big = [], 5 << 30
            writer = warc.ArchiveWriter(type("Out", (), {"write": lambda _, d: self.out.append(d), "close": lambda _: None})())
            writer.begin("big")
            writer.member["size"], head = big, b"".join(self.out)
            writer.at += big
            self.out.clear()
            writer.end()
            writer.close()
            self.parts, self.size = [(0, head), (len(head) + big, b"".join(self.out))], writer.at

        def seek(self, at):
            self.at = at

        def read(self, n):
            buf = bytearray(n)
            for start, data in self.parts:
                lo, hi = max(start, self.at), min(start + len(data), self.at + n)
                if lo < hi:
                    buf[lo - self.at : hi - self.at] = data[lo - start : hi - start]
            return bytes(buf)

    f = Sparse()
    assert warc.directory(f, f.size)["big"][1] == 5 << 30


def test_damage_is_noticed():
    record = warc.make_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), False, None)
    assert warc.parse_record(record)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload\r\n", b"pAyload\r\n"))
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"nothing"), 7)
    with pytest.raises((ValueError, struct.error)):
        warc.directory(io.BytesIO(b"PK\5\6" + b"\xff" * 18), 22)


def brute_lines(rows, ends, least=1):
    import re

    ranked = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in ranked:
        at, spans = 0, []
        for unit in re.split(ends, rows[i][1] or ""):
            normal = re.sub(r"[\x20\x09-\x0D]+", " ", unit.lower()).strip(" ")
            if normal and normal.count(" ") >= least - 1:
                if normal in seen:
                    spans.append((at, at + len(unit)))
                seen.add(normal)
            at += len(unit)
        out[i] = spans
    return out


@pytest.mark.parametrize(("separator", "ends"), [(line_dedup.LINE, r"(?<=\n)"), (line_dedup.SENTENCE, r"(?<=\n)|(?<=[.!?] )")])
def test_lines_equal_brute_force(docs, awkward, no_docs, separator, ends):
    want = brute_lines(awkward, ends)
    rows = line_dedup.repeats(docs, ["doc_id", "text", "n_chars"], separator=separator).collect()
    with_id = lambda keep: sorted(repr(x) for x in keep)
    assert with_id((r.doc_id, r.text, [(s.start, s.end) for s in r._removed]) for r in rows if r.doc_id is not None) == with_id((awkward[i][0], awkward[i][1], s) for i, s in want.items() if awkward[i][0] is not None)
    assert len(rows) == len(awkward) and sum(len(r._removed) for r in rows) == sum(map(len, want.values()))
    assert line_dedup.repeats(no_docs, ["doc_id"]).count() == 0


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "a b c d e\n\nf g h i j k\nx\n\nend"), (2, "F g  h i j k\nx\n\nmore")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in line_dedup.repeats(df, ["doc_id", "text"], separator=line_dedup.PARAGRAPH).collect()}
    assert rows[1]._removed == [] and [(s.start, s.end) for s in rows[2]._removed] == [(0, 16)]


def test_passages_inside_lines(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve! Thirteen fourteen fifteen sixteen seventeen"
    df = spark.createDataFrame([(1, f"start of it {passage} end."), (2, f"Another {passage} here"), (3, "clean text of its own. Nothing shared at all here.")], "doc_id bigint, text string")
    rows = {r.doc_id: [r.text[s.start : s.end] for s in r._removed] for r in line_dedup.repeats(df, ["doc_id", "text"], separator=line_dedup.SENTENCE).collect()}
    assert rows == {1: [], 2: ["Seven eight nine ten eleven twelve! "], 3: []}


def test_whole_lines_and_sentences_inside_them(spark, docs, awkward, no_docs):
    passage = "One two three four five six. Seven eight nine ten eleven twelve! End"
    texts = [
        (1, f"All rights reserved.\nAccept all. Learn more. Close now.\nstart {passage} here\n今日は良い天気です\n\n前置き。我们明天早上一起去公园散步吧。终"),
        (2, f"ALL  rights reserved.\nown line\nAccept all. Learn more. Close now.\n\nother {passage} there\n今日は良い天気です\n別の。我们明天早上一起去公园散步吧。完"),
        (3, "A new start. Seven eight nine ten eleven twelve! Then more.\nA new start. Seven eight nine ten eleven twelve! Then more."),
    ]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    rows = {r.doc_id: [r.text[s.start : s.end] for s in r._removed] for r in line_dedup.line_repeats(df, ["doc_id", "text"], least_words=5).collect()}
    assert rows[1] == []
    assert rows[2] == ["ALL  rights reserved.\n", "Accept all. Learn more. Close now.\n", "Seven eight nine ten eleven twelve! ", "今日は良い天気です\n", "我们明天早上一起去公园散步吧。"]
    assert rows[3] == ["Seven eight nine ten eleven twelve! ", "A new start. Seven eight nine ten eleven twelve! Then more."]
    # Without sentences, all later copies of lines go and nothing else.
    want = brute_lines(awkward, r"(?<=\n)", 1)
    got = line_dedup.line_repeats(docs, ["doc_id", "text"], least_words=1 << 30).collect()
    assert sorted(repr((r.doc_id, [(s.start, s.end) for s in r._removed])) for r in got if r.doc_id is not None and r.doc_id != 1) == sorted(repr((awkward[i][0], s)) for i, s in want.items() if awkward[i][0] not in (None, 1))
    assert line_dedup.line_repeats(no_docs, ["doc_id"]).count() == 0
