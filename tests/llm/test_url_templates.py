import random
import re
from collections import Counter, defaultdict

from paperlode.llm import url_templates as U


def plain_rule(host, path):
    best = None
    for r in U.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best)):
            best = r
    return best


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_templates(urls):
    rows = [(*plain_parts(u),) for u in urls]
    segs = []
    for _, p in rows:
        own = [s for s in p.split("/") if s]
        tail = ["*" if re.match(U._VARIABLE, s) else s for s in own[U.DEPTH :]]
        segs.append(own[: U.DEPTH] + ["\x1f".join(tail)] * bool(tail))
    now = [""] * len(rows)
    for d in range(U.DEPTH + 1):
        own = Counter((h, t, s[d]) for (h, _), s, t in zip(rows, segs, now) if len(s) > d and not re.match(U._VARIABLE, s[d]))
        now = [t if len(s) <= d else t + "/" + (s[d] if own[h, t, s[d]] >= U.LEAST_ROWS else "*" if d < U.DEPTH else "**") for (h, _), s, t in zip(rows, segs, now)]
    return [t + ("/" if p.endswith("/") else "") for (_, p), t in zip(rows, now)]


def plain_merge(rows):
    """rows: (host, template, bad or None) of each page."""
    n, bad = Counter(), Counter()
    for h, t, b in rows:
        n[h, t] += b is not None
        bad[h, t] += b or 0
    now = {k: k[1] for k in n}
    for d in range(U.DEPTH + 2, 0, -1):
        mask = {}
        for k, m in now.items():
            parts = m.split("/")
            mask[k] = "/".join(parts[:d] + ["*"] + parts[d + 1 :]) if len(parts) > d and parts[d] else m
        sib, pn, pb, on, ob = defaultdict(set), Counter(), Counter(), Counter(), Counter()
        for k, m in now.items():
            g = (k[0], mask[k])
            sib[g].add(m)
            pn[g] += n[k]
            pb[g] += bad[k]
            on[k[0], m] += n[k]
            ob[k[0], m] += bad[k]
        nxt = {}
        for k, m in now.items():
            g, o = (k[0], mask[k]), (k[0], m)
            rate = pb[g] / max(pn[g], 1)
            e = on[o] * rate
            nxt[k] = mask[k] if len(sib[g]) > 1 and (on[o] == 0 or (ob[o] - e) * (ob[o] - e) <= U.ALIKE * (e * (1 - rate))) else m
        now = nxt
    return now


def test_equals_brute_force(spark):
    r = random.Random(1)
    hosts = ["a.example.net", "B.example.com", "x.org", "net", "example.net:80", "cnet", *["spam.io"] * 9]
    urls = [(None, None), (1, None), (2, "no scheme/path"), (3, "http://"), (4, "http://HOST.NET"), (5, "http://h.net/"), (6, "a://b://c/d"), (7, "http://x.org/fr/é?q#f"), (8, "http://x.org#top"), (8, "http://x.org#top")]
    for i in range(9, 2500):
        h = r.choice(hosts)
        seg = [r.choice(["en", "de", "fr", "news"]), r.choice(["buy", "item", str(r.randrange(99)), f"p{r.randrange(40)}"]), str(r.randrange(10**6)), "deep", "deeper", "x", "y", r.choice(["z", "w"]), r.choice(["end", "17", "last"]), r.choice(["a", "b", "9"])][: r.randrange(0, 12)]
        urls.append((i, f"https://{h}/" + "/".join(seg) + r.choice(["", "/", "?a=1", "#b"])))
    labels = [(i, int("spam" in (u or "") and "/buy" in u or r.random() < 0.1)) for i, u in urls if i and i % 2] + [(9, None), (None, 1)]
    got = U.judge(spark.createDataFrame([(i, u, "c", 1) for i, u in urls], "page_id long, url string, host string, n int"), spark.createDataFrame([(i, b, "c") for i, b in labels], "page_id long, bad int, url string")).collect()
    known = {i: b for i, b in labels if i is not None and b is not None}
    tree = plain_templates([u for _, u in urls])
    rows = [(plain_parts(u)[0], t, known.get(i)) for (i, u), t in zip(urls, tree)]
    joined = plain_merge(rows)
    n, bad = Counter(), Counter()
    for h, t, b in rows:
        n[h, joined[h, t]] += b is not None
        bad[h, joined[h, t]] += b or 0
    overall = sum(bad.values()) / sum(n.values())
    want = []
    for (i, u), (h, t, _) in zip(urls, rows):
        m = joined[h, t]
        purity = (bad[h, m] + U.PRIOR_WEIGHT * overall) / (n[h, m] + U.PRIOR_WEIGHT)
        rule = plain_rule(*plain_parts(u))
        verdict = U.RULES[rule] if rule else "block" if n[h, m] >= U.LEAST_LABELS and purity >= U.PURITY else "allow"
        want.append((i, *plain_parts(u), rule, verdict, m.replace("\x1f", "/"), round(purity, 9)))
    assert sorted(((*tuple(x)[:6], round(x.purity, 9)) for x in got), key=str) == sorted(want, key=str)
    assert any(x.verdict == "block" and x.rule is None for x in got)


def test_a_small_bad_section_of_a_hot_host_is_rejected(spark):
    r = random.Random(3)
    urls = [(i, f"http://hot.io/{r.choice(['bad'] + [f's{k}' for k in range(40)])}/x{i}") for i in range(6000)]
    deep = "/".join(f"d{k}" for k in range(14))
    urls += [(9000 + i, f"http://hot.io/{deep}/{'worse' if i % 2 else 'fine'}/{i}") for i in range(240)]
    urls = [(i, u.replace("/x", "/")) for i, u in urls]
    bad = lambda u: "/bad/" in u or "/worse/" in u
    labels = [(i, int(bad(u))) for i, u in urls if i % 3 == 0]
    got = U.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {x.page_id for x in got if x.verdict == "block"} == {i for i, u in urls if bad(u)}


def test_empty_tables(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")
    assert U.judge(pages, labels).collect() == []
    got = U.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), labels).collect()
    assert [(x.verdict, x.purity) for x in got] == [("allow", 0.0)]
