"""Records: carving decides what is read back, and validators of files with several ends."""

import random
import time

from replisift.llm import media, toxicity
from tests.llm.helpers import TEXTS, docs
from tests.llm.test_texts import samples


def test_read_back_is_what_is_carved(spark):
    rows = media.text_media(docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert {r.media_type for r in rows} == {"png", "wav"} and len({r.declared_type for r in rows}) > 2
    assert all(r.corrected == (r.declared_type != r.media_type) for r in rows) and {r.corrected for r in rows} == {True, False}
    sniff = media.Sniffer()
    for r in rows:
        assert media.read_record(sniff, media.record(bytes(r.media), "png", "x" * 9)) == ("png", r.media_type, bytes(r.media))
    for kind, data in samples().items():
        assert media.read_record(sniff, media.record(data, "x/y")) == ("x/y", kind, data)


def test_media_in_texts_are_carved(spark):
    pdf = "%PDF-1.4\nstartxref\n0\n%%EOF\nupdate\nstartxref\n9\n%%EOF"
    texts = [(1, f"see {pdf} and more"), (2, "%PDF-1.4 no end"), (3, f"{pdf}{pdf}")]
    got = {r.doc_id: r.feature.split("carved=")[1] for r in media.text_media(docs(spark, texts)).collect()}
    assert got == {1: f"pdf@4+{len(pdf)}", 2: "", 3: f"pdf@0+{len(pdf)},pdf@{len(pdf)}+{len(pdf)}"}


def test_many_headers_are_read_once():
    data, sniff = b"%PDF-1.4 " * 200_000, media.Sniffer()
    start = time.time()
    assert sniff.find(data) == [] and time.time() - start < 10


def test_large_boxes():
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    wide = b"\0\0\0\1mdat" + (16 + 5).to_bytes(8, "big") + b"12345"
    head = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", b"x" * 9)
    sniff = media.Sniffer()
    assert sniff.find(b"??" + head + wide + b"\0\0") == [("mp4", 2, len(head + wide))]
    last = head + b"\0\0\0\0mdat" + bytes(random.Random(1).randrange(256) for _ in range(50))
    assert sniff.find(last) == [("mp4", 0, len(last))]


def test_swap_sets_are_a_parameter():
    rows = [(b"the zorp is bad", 1), (b"the zorp is nasty", 1), (b"a fine day", 0), (b"the vleen is fine", 0)] * 5
    assert toxicity.fit(rows).n_swaps == 0
    assert toxicity.fit(rows, identity=["zorp vleen quab"]).n_swaps == 30
    assert toxicity.swaps({b"zorp", b"x"}, ["zorp vleen"]) == [(b"zorp", b"vleen")]


def test_forms_and_places_differ_by_text(spark):
    """Both forms, right and wrong declarations, and beginnings of several lengths; the payload comes back from each."""
    rng, sniff = random.Random(3), media.Sniffer()
    seen = set()
    for _ in range(300):
        payload = bytes(rng.choice(b"RIFFWAVEBM\x00a") for _ in range(64 * rng.randrange(1, 4)))
        data = media.text_record(payload)
        declared, kind, found = media.read_record(sniff, data)
        assert media.read_samples(found) == payload
        seen.add((declared, kind, data.index(found)))
    assert {(d == k) for d, k, _ in seen} == {True, False} and len({a for *_, a in seen}) >= 5 and {k for _, k, _ in seen} == {"png", "wav"}
    df = spark.createDataFrame([(1, bytearray(media.text_record(bytes(64))), "text")], "doc_id long, body binary, declared string")
    row = media.sniff_media(df, "body", "declared").first()
    assert row.media_type is None and len(row.carved) == 1 and media.read_samples(bytes(row.carved[0].data)) == bytes(64)
