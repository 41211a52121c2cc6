import random
import re

from hopframe.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for label, p in license_scan.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    labels = sorted({x for _, x in at})
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(labels)


def test_base_equals_brute_force_and_templates_add_labels(spark):
    r = random.Random(5)
    vocab = "under the mit license apache version 2 cc by nc x É".split()
    docs = [(i, " ".join(r.choice([w, w.upper()]) for w in r.choices(vocab, k=r.randint(0, 60))), "q") for i in range(300)]
    docs += [(1000, None, None), (1001, "", "q"), (1002, "--under, the MIT\nlicense!", "q"), (None, "cc by nc", "q"), (1003, "Under the mit license " * 400, "q")]
    text = "This work is licensed under the GNU General Public License, version 3."
    docs += [(2000, "intro " * 50 + text + " outro" * 9, "q"), (2001, text.replace("General", "general old"), "q"), (2002, "gnu general public holiday", "q"), (7, "cc by nc", "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    rows = license_scan.scan(df).collect()
    assert len(rows) == len(docs)
    key = lambda d: -1 if d is None else d
    want = sorted(str((key(d), brute(t))) for d, t, _ in docs)
    got = sorted(str((key(r.doc_id), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in rows)
    assert got == want
    by = {r.doc_id: r for r in rows}
    assert by[2000].labels == "gpl-3" and by[2000].score == 1.0 and "gpl-3" in by[2001].labels
    assert "gpl-3" not in by[2002].labels and by[1000].labels == "" and by[1000].score == 0.0
    assert by[2000].spans[0].first == 53 and all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = license_scan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def plain_votes(text, base, more, k=3, gap=2, coverage=0.75):
    """Labels, score and spans by plain loops: votes by diagonal, merged where diagonals are near."""
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spans, best = [], {}
    for tid, (label, t) in enumerate([*base, *more]):
        ts, votes = t.split(), {}
        for i in range(len(ws) - k + 1):
            for j in range(len(ts) - k + 1):
                if ws[i : i + k] == ts[j : j + k]:
                    votes.setdefault(i - j, set()).add(j)
        islands = []
        for d in sorted(votes):
            if not islands or d - islands[-1][-1] > gap:
                islands.append([])
            islands[-1].append(d)
        for ds in islands:
            seen = set().union(*(votes[d] for d in ds))
            share = len({j + x for j in seen for x in range(k)}) / len(ts)
            whole = tid >= len(base) or any(len(votes[d]) == len(ts) - k + 1 for d in ds)
            first, end = min(d + min(votes[d]) for d in ds), max(d + max(votes[d]) + k for d in ds)
            spans.append((label, first, end, share, whole))
            best[first] = max(best.get(first, 0), share)
    good = sorted(s[:4] for s in spans if s[3] >= coverage and s[3] == best[s[1]] and s[4])
    return ",".join(sorted({s[0] for s in good})), max((s[3] for s in spans), default=0.0), good


def test_labels_score_and_spans_equal_plain_votes(spark):
    r = random.Random(11)
    more = [*license_scan.TEMPLATES, ("kelvin", "kelvin scale of the kind lord kelvin gave")]
    texts = [t for _, t in (*license_scan.BASE, *more)]
    vocab = sorted({w for t in texts for w in t.split()})
    docs = []
    for i in range(250):
        ws = []
        for _ in range(r.randint(1, 4)):
            t = r.choice(texts).split()
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                at = r.randrange(len(t) + 1)
                t = r.choice((t[:at] + t[at + 1 :], t[:at] + [r.choice(vocab)] + t[at:], t[: at + 4]))
            ws += t + r.choices(vocab, k=r.randint(0, 6))
        docs.append((i, " ".join(r.choice((w, w.upper())) for w in ws), "q"))
    docs += [(900, "the \u212aelvin scale of the kind Lord \u212aelvin gave", "q"), (901, "The Kelvin SCALE of the kind lord kelvin gave", "q"), (902, "word " * 150_000 + texts[3], "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, `a``b` string")
    rows = license_scan.scan(df, more=more).collect()
    assert len(rows) == len(docs)
    for row in rows:
        labels, score, spans = plain_votes(dict((d[0], d[1]) for d in docs)[row.doc_id] if row.doc_id != 902 else "word " * 5 + texts[3], license_scan.BASE, more)
        if row.doc_id == 902:
            spans = [(a, b + 149_995, c + 149_995, d) for a, b, c, d in spans]
        assert (row.labels, round(row.score, 9)) == (labels, round(score, 9))
        assert [(s.label, s.first, s.end, round(s.share, 9)) for s in row.spans] == [(*s[:3], round(s[3], 9)) for s in spans]
    by = {r.doc_id: r for r in rows}
    assert by[901].labels == "kelvin" and by[900].labels == ""
