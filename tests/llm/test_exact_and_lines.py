import hashlib
import random
import re

from pyspark.sql import functions as F

from linkforge.llm import exact_dedup, line_dedup, url_filter

BLANKS = " \t\n\x0b\x0c\r"


def docs(spark, rows):
    # Columns whose names an operator might use itself.
    return spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, _id long, kept string")


EDGE = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "ab"), (6, "a\tb\u00a0"), (7, "ab"), (7, "ab"), (None, "a b"), (8, "é" * 5000), (9, "é" * 5000 + " "), (10, "unique")]


def test_exact_dedup_edges(spark):
    got = exact_dedup.exact_dedup(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by_id[1] == [(3, 3, False)] and by_id[3] == [(3, 3, True)]
    # "a b" twice with the most code points: the smaller id stays, and a null id never before another.
    assert by_id[4] == [(4, 5, True)] and by_id[None] == [(4, 5, False)] and by_id[7] == [(4, 5, False)] * 2
    assert by_id[8] == [(9, 2, False)] and by_id[10] == [(10, 1, True)] and by_id[6] == [(6, 1, True)]
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def test_exact_dedup_hash_is_made_for_survivors_only(spark):
    got = {r.doc_id: r.full_hash for r in exact_dedup.exact_dedup(docs(spark, EDGE)).collect()}
    assert got[10] is None and got[4] == hashlib.sha256(b"ab").hexdigest()


def test_exact_dedup_digest_is_made_for_all(spark):
    got = exact_dedup.exact_dedup(docs(spark, EDGE), digest="sha").collect()
    sha = {i: hashlib.sha256("".join(c for c in t or "" if c not in BLANKS).encode()).hexdigest() for i, t in EDGE}
    assert all(r.sha == sha[r.doc_id] and r.full_hash in (None, r.sha) for r in got) and {r.doc_id for r in got if r.full_hash is None} == {10, 6}


def test_exact_dedup_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = docs(spark, [(i, f"text {i % 30}" * (i % 5)) for i in range(200)])
    key = lambda df: sorted(map(tuple, df.drop("full_hash").collect()))
    want = key(exact_dedup.exact_dedup(rows))
    monkeypatch.setattr(exact_dedup, "fitting", lambda n, most: 6)
    assert key(exact_dedup.exact_dedup(rows)) == want


def brute_lines(rows, k, min_words=None):
    """Lines to delete by comparing every window of k non-blank lines, and every line of min_words words, with those before it."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        at = [(n, x.strip(BLANKS)) for n, x in enumerate((t or "").split("\n")) if x.strip(BLANKS)]
        gone = set()
        for j in range(len(at) - k + 1):
            w = tuple(x for _, x in at[j : j + k])
            if w in seen:
                gone |= {n for n, _ in at[j : j + k]}
            seen.add(w)
        for n, x in at if min_words else ():
            if len(x.split()) >= min_words:
                if (x,) in seen:
                    gone.add(n)
                seen.add((x,))
        out[i] = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
    return out


def brute_runs(rows, k):
    """Number and greatest length of the maximal copied runs, from the common prefixes of all pairs of places."""
    lines = {i: [x.strip(BLANKS) for x in (t or "").split("\n") if x.strip(BLANKS)] for i, t in rows}
    places = [(i, j) for i in sorted(lines) for j in range(len(lines[i]))]
    out = {}
    for d in lines:
        reach, runs, last = 0, [], None
        for j in range(len(lines[d])):
            common = {}
            for p in places:
                if p < (d, j):
                    n = 0
                    while j + n < len(lines[d]) and p[1] + n < len(lines[p[0]]) and lines[d][j + n] == lines[p[0]][p[1] + n]:
                        n += 1
                    common[p] = n
            best, h = max(common.values(), default=0), k
            if best < k:
                continue
            while 2 * h <= best:
                h *= 2
            source = min(p for p, n in common.items() if n >= h)
            if j + h <= reach:
                continue
            if last and last == (source[0], source[1] - j) and reach >= j:
                runs[-1][1] = j + h
            else:
                runs.append([j, j + h])
            reach, last = j + h, (source[0], source[1] - j)
        out[d] = (len(runs), max((b - a for a, b in runs), default=0))
    return out


def test_line_dedup_against_brute_force(spark):
    random.seed(5)
    rows = []
    for i in range(60):
        lines = [random.choice(["a", "b", "c", " d ", "", "e\r", f"own {i} {j}"]) for j in range(random.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(60, "a\na\na\na"), (61, rows[3][1]), (62, ""), (63, "\n\n")]
    for k in (1, 2, 3, 5):
        out = line_dedup.line_dedup(docs(spark, rows), min_lines=k).collect()
        assert {r.doc_id: r.text for r in out} == brute_lines(rows, k), k
        assert {r.doc_id: (r.n_runs, r.longest_run) for r in out} == brute_runs(rows, k), k


def test_line_dedup_edges(spark):
    rows = docs(spark, [(1, None), (2, "x\ny"), (2, "x\ny"), (None, "x\ny\nz"), (3, "")])
    out = line_dedup.line_dedup(rows)
    assert out.columns == ["doc_id", "text", "_id", "kept", *line_dedup.COUNTS]
    got = sorted(((r.doc_id is None, r.doc_id, r.text, r.n_lines, r.n_removed_lines, r.n_runs, r.longest_run) for r in out.collect()), key=str)
    assert got == sorted([(False, 1, None, 0, 0, 0, 0), (False, 2, "x\ny", 2, 0, 0, 0), (False, 2, "x\ny", 2, 0, 0, 0), (True, None, "z", 3, 2, 1, 2), (False, 3, "", 0, 0, 0, 0)], key=str)
    assert line_dedup.line_dedup(docs(spark, [])).collect() == []


def test_line_dedup_of_passages_on_one_line(spark):
    long, short = " ".join(f"w{j}" for j in range(50)), " ".join(f"w{j}" for j in range(49))
    rows = [(1, f"a\n{long}\nb"), (2, long), (2, long), (3, f"c\n\n \t{long}\r\nd\n{short}"), (4, f"e\n{short}\nf\n{long}\n\n{long}"), (5, f"d\n{short}\n{long}")]
    got = {r.doc_id: (r.text, r.n_removed_lines, r.n_runs) for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("", 1, 1), 3: (f"c\n\nd\n{short}", 1, 1), 4: (f"e\n{short}\nf\n", 2, 2), 5: ("", 3, 2)}
    off = {r.doc_id: r.n_removed_lines for r in line_dedup.line_dedup(docs(spark, rows), min_words=None).collect()}
    assert off == {1: 0, 2: 0, 3: 0, 4: 0, 5: 2}


def test_line_dedup_of_runs_of_any_length(spark):
    # Document n repeats n lines of the first one; a hot line stands in all of them, and one is very long.
    first = [f"line {j}" for j in range(60)]
    rows = [(0, "\n".join(first))] + [(n, "\n".join(["hot", *first[5 : 5 + n], f"own {n}"])) for n in range(1, 51)]
    rows += [(100, "\n".join(["hot", *(f"x{j}" for j in range(3000))])), (101, "\n".join(["hot", *(f"x{j}" for j in range(3000))]))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    want = brute_lines(rows, 2)
    assert {i: r.text for i, r in got.items()} == want
    # hot and the line after it repeat together from document 2 on.
    assert [(got[n].n_removed_lines, got[n].n_runs, got[n].longest_run) for n in range(1, 51)] == [(0, 0, 0)] + [(n + 1, got[n].n_runs, got[n].longest_run) for n in range(2, 51)]
    assert all(got[n].longest_run in (n, n + 1) for n in range(2, 51)) and (got[101].n_runs, got[101].longest_run) == (1, 3001)


def test_line_dedup_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x\ny", 3, 1, "a", 2), (2, "x\ny\nz", 5, 1, "b", 2)], "doc_id long, text string, n_chars int, n_lines int, _runs string, n_runs int")
    out = line_dedup.line_dedup(df, length_col="n_chars")
    assert out.columns == ["doc_id", "text", "n_chars", "_runs", *line_dedup.COUNTS]
    assert sorted(map(tuple, out.collect())) == [(1, "x\ny", 3, "a", 2, 0, 0, 0), (2, "z", 1, "b", 3, 2, 1, 2)]
    plain = line_dedup.line_dedup(df, counts=False, length_col="n_chars")
    assert plain.schema == df.schema and sorted(map(tuple, plain.collect())) == [(1, "x\ny", 3, 1, "a", 2), (2, "z", 1, 1, "b", 2)]


def test_line_dedup_stays_in_the_jvm(spark):
    plan = line_dedup.line_dedup(docs(spark, [(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("example.com", "/", "block"), ("a.net", "/es/x", "allow"), ("net", "/es/", "zzz"), (None, "/", "block")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, a) for h, p, a in RULES if h and a != "zzz" and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_filter_against_brute_force(spark):
    random.seed(2)
    urls = [None, "", "no scheme.com/", "http://", "https://EXAMPLE.com/en/?q", "http://com/x", "http://.com/", "ftp://a.b.net/es/x#y", "http://a.net/es/x", "http://xcom/", "http://example.com?x=/en/", "a://b://c.com/d"]
    labels = ["www", "example", "a", "b", "com", "net", "org", "Ünï"]
    urls += [f"http://{'.'.join(random.choices(labels, k=random.randint(1, 4)))}{random.choice(['', '/', '/en/', '/es/x', '/fr/', '/en'])}{random.choice(['', '?a', '#b'])}" for _ in range(400)]
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.com/", "h")] * 2, "page_id long, url string, host string")
    for ranges in (1, 7):
        got = url_filter.url_filter(pages, rules, ranges=ranges).collect()
        assert len(got) == len(urls) + 2
        for r in got:
            if r.page_id is not None:
                assert (r.host, r.path, r.rule, r.verdict) == brute_url(urls[r.page_id]), urls[r.page_id]
    # Ranges go on over the ends of batches; ties of rules and very long urls are judged as well.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    long = spark.createDataFrame([(9000, "http://www.example.com/en/" + "x" * 1_000_000, "h")], pages.schema)
    small = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages.union(long), rules, ranges=2).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(small[i] == brute_url(u) for i, u in enumerate(urls)) and small[9000][2:] == ("www.example.com/en/", "allow")
    empty = url_filter.url_filter(pages, rules.limit(0)).select("verdict", F.col("rule").isNull().alias("n")).distinct().collect()
    assert [tuple(r) for r in empty] == [("allow", True)]
    assert url_filter.url_filter(pages.limit(0), rules).collect() == []
