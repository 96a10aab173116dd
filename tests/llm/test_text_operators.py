"""Line dedup, quality rules, url filters and licence scans against plain Python."""

import hashlib
import re
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.llm import licences, line_dedup, quality, urls
from loomgraph.llm.text import BLANKS

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def deduped(rows, min_docs=3):
    holders = defaultdict(set)
    key = lambda line: line.translate(UPPER).strip(BLANKS)
    order = lambda i: -(2**63) if i is None else i
    for id_, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(id_))
    out = []
    for id_, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != order(id_))]
        out.append((id_, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force_also_when_runs_are_cut(spark, frame, odd_rows):
    shared = "A line that many of the documents share"
    rows = odd_rows + [(i, f"own line number {i} is long enough\n {shared}\t\n{'x' * (i % 3)}\n{shared.upper()}") for i in range(20, 60)]
    for run_rows in (20_000, 7):
        got = line_dedup.dedup(frame(rows), run_rows=run_rows)
        assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_text").toLocalIterator()), key=repr) == deduped(rows)
    assert got.columns[:9] == frame(rows).columns
    assert line_dedup.dedup(frame([])).count() == 0


def test_keep_bitmap_has_a_bit_per_line(spark, frame):
    lines = "\n".join(f"shared line of text number {i}" for i in range(70))
    found = line_dedup.keep_bitmaps(frame([(1, lines), (2, lines), (3, lines + "\nlast")])).orderBy("_doc").toLocalIterator()
    assert [(r._doc, r.n_dropped, [(w.word, w.bits) for w in r.keep]) for r in found] == [
        (i, 70, [(0, 0), (1, -(1 << 6))]) for i in (1, 2)
    ]


def base(text):
    words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for found in windows.values() if len(found) > 1 for i in found for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_match_brute_force(spark, frame, odd_rows):
    rows = odd_rows + [(11, "a b c a b c a b\nx\nx\n\n \n \nx #*$ <"), (12, "to to to to to"), (13, "é É é\né É é")]
    got = quality.score(frame(rows)).toLocalIterator()
    seen = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got}
    want = set()
    for id_, text, *_ in rows:
        n = base(text)
        want.add((id_, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert seen == want
    assert quality.score(frame([])).count() == 0


def test_kept_documents_are_measured_once(frame, odd_rows, monkeypatch):
    seen, measure = [], quality.measured
    monkeypatch.setattr(quality, "measured", lambda docs: seen.append(docs) or measure(docs))
    kept = quality.keep_good(frame(odd_rows))
    verdicts = [r.doc_id for r in quality.score(frame(odd_rows)).toLocalIterator() if r.kept]
    order = lambda i: (i is None, i or 0)
    assert sorted([r.doc_id for r in kept.toLocalIterator()], key=order) == sorted(verdicts, key=order) and verdicts
    assert len(seen) == 2  # One of them is that of the scores.


def test_quality_rules_find_junk_and_keep_clean_texts(spark, frame):
    from tests.llm.conftest import prose

    clean = [(i, prose(i, 150)) for i in range(60)]
    marked = [(100 + i, re.sub(r"(\S)( |$)", r"\1###\2", prose(200 + i, 150))) for i in range(6)]
    shouted = [(200 + i, prose(300 + i, 150).upper().replace(" ", "!! ")) for i in range(6)]
    kept = {r.doc_id for r in quality.keep_good(frame(clean + marked + shouted)).toLocalIterator()}
    assert kept == set(range(60))
    assert quality.keep_good(frame(clean)).columns == frame(clean).columns


def test_copies_and_texts_that_fail_the_base_test_do_not_hide_junk(spark, frame):
    from tests.llm.conftest import prose

    clean = [(i, prose(i, 150)) for i in range(60)]
    marked = [(100 + i, re.sub(r"(\S)( |$)", r"\1###\2", prose(200 + i, 150))) for i in range(4)]
    copies = [(1000 + i, "to be sold here " * 40) for i in range(32)]
    rows = clean + marked + copies
    assert {r.doc_id for r in quality.keep_good(frame(rows)).toLocalIterator()} == set(range(60))
    assert {r.doc_id for r in quality.score(frame(rows)).toLocalIterator() if r.kept} == set(range(60))
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    passing = quality.score(small).where("not base_failed").select("kept", (F.col("n_symbols") > 0.1 * F.col("n_words")).alias("junk"))
    assert {(r.kept, r.junk): r["count"] for r in passing.groupBy("kept", "junk").count().toLocalIterator()} == {(True, False): 160, (False, True): 11}


def test_posteriors_match_a_plain_estimation(spark):
    votes = [([1] * 8, 90), ([2, 1, 1, 1, 1, 1, 1, 2], 6), ([1, 2, 0, 2, 2, 1, 2, 1], 4), ([0] * 8, 3)]
    codes = [sum(v * 3**i for i, v in enumerate(vote)) for vote, n in votes for _ in range(n)]
    got = {r.code: r.p_good for r in quality.posteriors(spark.createDataFrame([(c,) for c in codes], "code int")).toLocalIterator()}
    q = [0.1 if 2 in vote else 0.9 for vote, _ in votes]
    for _ in range(quality.ROUNDS):
        good, bad = (sum(n * w for (_, n), w in zip(votes, ws, strict=True)) for ws in (q, [1 - x for x in q]))
        theta = [[[(1 + sum(n * w for (vote, n), w in zip(votes, ws, strict=True) if vote[j] == o)) / (3 + total) for o in range(3)] for j in range(8)]
                 for ws, total in ((q, good), ([1 - x for x in q], bad))]
        prior = (1 + good) / (2 + good + bad)
        odds = []
        for vote, _ in votes:
            ratio = prior / (1 - prior)
            for j, v in enumerate(vote):
                ratio *= theta[0][j][v] / theta[1][j][v]
            odds.append(ratio)
        q = [r / (1 + r) for r in odds]
    want = {sum(v * 3**i for i, v in enumerate(vote)): x for (vote, _), x in zip(votes, q, strict=True)}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in got)


RULES = [urls.prefix_rule("org", "/", "allow"), urls.prefix_rule("example.org", "/es/", "block"), urls.prefix_rule("com", "/de", "block"),
         urls.pattern_rule("|casino-*."), urls.pattern_rule("/ads/*"), urls.pattern_rule("*.exe", "allow"), urls.pattern_rule("*bad*")]


def test_urls_are_judged_as_if_every_rule_ran(spark):
    rows = ["http://a.example.org/es/1", "http://example.org/en", "http://EXAMPLE.org", "https://x.com/dex?q", "https://x.com/ads/1?y",
            "http://blog.casino-win.net/a", "http://notcasino-win.net/a", "http://q.net/file.exe", "http://q.net/verybad", "x.org/es/", None, "", "http://q.net/ads/b?u=/ads/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows + rows[:3])], "page_id int, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filtered(pages, RULES).select("_own.page_id", "host", "path", "rule", "verdict").toLocalIterator()}
    want = set()
    for i, url in enumerate(rows + rows[:3]):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(.*)", url or "")
        host, path, rest = (found[1].translate(UPPER), found[2], found[3]) if found else ("", "", "")
        fits = [r for r in RULES if re.search(r.pattern, host + path + rest)]
        best = max(fits, key=lambda r: (r.rank, len(r.name), r.verdict == "block", r.name), default=None)
        want.add((i, host, path, best and best.name, best.verdict if best else "allow"))
    assert got == want
    small, urls.SMALL_RULES = urls.SMALL_RULES, 1
    try:
        salted = urls.filtered(pages, RULES).select("_own.page_id", "host", "path", "rule", "verdict")
        assert {tuple(r) for r in salted.toLocalIterator()} == want
    finally:
        urls.SMALL_RULES = small
    assert urls.filtered(pages.limit(0), RULES).count() == 0


def test_licences_are_found_through_other_spellings_and_copyright_lines(spark, frame, odd_rows):
    mit = "Copyright (c) 2001 Someone\n\n" + licences.LICENCES["MIT"].upper().replace("\n", "\n\n  ").replace(",", " ;")
    rows = odd_rows + [(20, mit), (21, licences.LICENCES["Zlib"].replace("acknowledgment", "acknowledgement")), (22, licences.LICENCES["ISC"] + " x"),
                       (23, "text\n  released under the M.I.T. licence\nRELEASED UNDER THE MIT LICENCE!\nLicensed under CC-BY-NC 4.0"), (24, "Copyright 2001 X")]
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(frame(rows)).select("_own.doc_id", "licence", "notices").toLocalIterator() if r.doc_id}
    assert got[20] == ("MIT", []) and got[21][0] == "Zlib" and got[22] == (None, []) and got[24] == (None, [])
    assert got[23] == (None, ["CC-BY-NC-4.0", "MIT"])
    assert all(got[i] == (None, []) for i in range(1, 11))
    assert licences.scan(frame([])).count() == 0


def test_whole_licences_are_found_with_titles_and_any_copyright_line(spark, frame):
    folder = Path(licences.__file__).parent / "licence_texts"
    names = sorted(licences.TITLES)
    rows = [(i, (folder / f"{name}.txt").read_text()) for i, name in enumerate(names)]
    mit = " ".join(licences.LICENCES["MIT"].split())
    rows += [(50, "MIT License\n\nCopyright (c) Microsoft Corporation\n\n" + mit), (51, "Copyright The Authors\n" + licences.LICENCES["MIT"])]
    rows += [(52, rows[names.index("GPL-3.0")][1].split("END OF TERMS")[0]), (53, rows[names.index("BSD-3-Clause")][1].split("\n", 1)[1])]
    got = {r.doc_id: r.licence for r in licences.scan(frame(rows)).select("_own.doc_id", "licence").toLocalIterator()}
    assert got == {**dict(enumerate(names)), 50: "MIT", 51: "MIT", 52: "GPL-3.0", 53: "BSD-3-Clause"}


def test_hashes_of_texts_are_of_their_bytes(spark, frame):
    row = line_dedup.dedup(frame([(1, "É\n")])).select(F.sha2("kept_text", 256).alias("h")).first()
    assert row.h == hashlib.sha256("É\n".encode()).hexdigest()
