"""Pages and archives that are broken or made to be slow; evidence of languages against plain Python."""

import gzip
import math
import random
import re
import time

import numpy as np

from scissile.llm import language_id, warc


def test_visible_is_what_patterns_say():
    rng = random.Random(1)
    parts = [b"<!--", b"-->", b"<script", b"<SCRIPT src=x>", b"</script >", b"</script", b"<style>", b"</style>", b"<", b">", b"<b>", b"x", b" ", b"&amp;", b"<scripts>", b"<html ", b"<html>", b'lang="de"', b"LANG = fr", b"<html lang=es>", b"xlang=it", b"\n"]
    hidden, tag = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I), re.compile(rb"<[^>]*>")
    declares = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
    for _ in range(4000):
        html = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert language_id.without_hidden(html) == hidden.sub(b" ", html), html
        assert language_id.visible(html) == tag.sub(b" ", hidden.sub(b" ", html)).replace(b"&amp;", b"&"), html
        found = declares.search(html)
        assert language_id.declared_language(html) == (found[1].decode().lower() if found else ""), html


def test_open_tags_take_linear_time():
    for piece in (b"<!--", b"<script ", b"<", b"<html ", b"<style><!--", b"<html lang"):
        html = piece * (10_000_000 // len(piece))
        began = time.perf_counter()
        language_id.visible(html)
        language_id.declared_language(html)
        assert time.perf_counter() - began < 20, piece


def test_evidence_is_fused_as_said(spark):
    """All defined cases at once: nulls, ties, one page on a host or a domain, repeated rows, clashing columns."""
    languages = ["aa", "bb", "cc"]
    rng = random.Random(7)
    hosts = [("w.x.aa", "x.aa", "aa"), ("v.x.aa", "x.aa", "aa"), ("one.bb", "one.bb", "bb"), ("", "", ""), ("h.y.cc", "y.cc", "cc")]
    pages = [(k, *rng.choice(hosts[:4]), rng.choice(["", "aa", "bb", "other"]), [round(rng.uniform(-3, 0), 2) for _ in languages]) for k in range(40)]
    pages += [(40, *hosts[4], "cc", [0.0, 0.0, 0.0]), (None, *hosts[0], "", [0.0, -1.0, -1.0]), pages[0], pages[0]]
    got = language_id.fused(spark.createDataFrame(pages, "page_id long, host string, domain string, suffix string, declared string, text array<double>"), languages).collect()
    posterior = lambda x: np.exp(x) / np.exp(x).sum()
    q = [posterior(np.array(p[5])) for p in pages]
    total = sum(q)
    want = []
    for i, p in enumerate(pages):
        of = lambda k, p=p, i=i: sum((q[j] for j, o in enumerate(pages) if o[k] == p[k] and j != i), np.zeros(3))
        rest = total - q[i]
        scaled = lambda x: x / x.sum()
        prior = scaled(of(1) + 5 * scaled(of(2) + 5 * (total + 1) / (total.sum() + 3)))
        log_m = np.log((of(4) + 1) / (rest + 5)) if p[4] else np.zeros(3)
        log_s = np.log((of(3) + 5) / (rest + 15))
        r = posterior(np.array(p[5]) + log_m + log_s + np.log(prior))
        want.append((p[0], languages[int(r.argmax())], r.max(), languages[int(np.argmax(p[5]))]))
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(([r["page_id"], r["lang"], r["p"], r["text_lang"]] for r in got), key=key), sorted(want, key=key), strict=True):
        assert (g[0], g[1], g[3]) == (w[0], w[1], w[3]) and math.isclose(g[2], w[2], rel_tol=1e-9)
    read = spark.createDataFrame([(1, None, None, 5), (2, "http://u@H.Example.AA:80/p", "", 5), (3, "nonsense", '<html lang="aa"><p>x</p>', 5)], "page_id long, url string, html string, host int")
    model = language_id.TextModel(languages, np.log(np.full((3, language_id.BUCKETS), 1 / language_id.BUCKETS)))
    rows = {r["page_id"]: r for r in language_id.text_evidence(read, model).collect()}
    assert [(rows[k]["host"], rows[k]["domain"], rows[k]["suffix"], rows[k]["declared"]) for k in (1, 2, 3)] == [("", "", "", ""), ("h.example.aa", "example.aa", "aa", ""), ("", "", "", "aa")]
    assert language_id.fused(language_id.text_evidence(read.limit(0), model), languages).count() == 0


def test_broken_archives(spark, tmp_path):
    good = lambda k, body=b"abc": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nX-Page-ID: %d\r\nContent-Length: %d\r\n\r\n" % (k, k, len(body)) + body + b"\r\n\r\n"
    files = {
        "a": good(1) + b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r2>\r\nX-Page-ID: 2\r\n\r\nbody\r\n\r\n" + good(3),
        "b": good(4) + b"WARC/1.1\r\nWARC-Record-ID: <r5>\r\nX-Page-ID: 5\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" + good(6) + b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 7",
        "c": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r8>\r\nX-Page-ID: 8\r\nContent-Length: 900\r\n\r\nshort",
        "d": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r9>\r\nX-Page-ID: nine\r\nContent-Length: x\r\n\r\nbody",
        "e": gzip.compress(good(10)) + gzip.compress(good(11, random.Random(1).randbytes(5000)))[:-30], "f": gzip.compress(good(12)) + b"rubbish", "g": b"\x1f\x8brubbish", "h": b"", "i": b"\xff\xfe no record",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.payloads(warc.read_archives(spark, str(tmp_path))).collect()
    got = {r["record_id"] or f"page {r['page_id']}": r["problem"] for r in rows}
    assert {k: v for k, v in got.items() if v is None} == dict.fromkeys(("r1", "r3", "r4", "r6", "r10", "r12"))
    assert {k: v for k, v in got.items() if v} == {"r2": "no length", "r5": "no type", "page 7": "no end of header", "r8": "cut off", "r9": "no length", "r11": "cut off"}
    assert all(r["payload"] is None for r in rows if r["problem"]) and len(rows) == len(got)
    part = good(20)[:-4].replace(b"X-Page-ID", b"WARC-Segment-Number: 1\r\nX-Page-ID")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "j").write_bytes(part + b"\r\n\r\nWARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: <r21>\r\nWARC-Segment-Origin-ID: <r20>\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 9\r\nContent-Length: 6\r\n\r\nde")
    assert [(r["page_id"], r["problem"]) for r in warc.payloads(warc.read_archives(spark, str(tmp_path / "two"))).collect()] == [(20, "cut off")]
