import math
import random
import re
from collections import Counter, defaultdict

from grovetally.llm import urls
from grovetally.llm.queries import URL_RULES


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def rule_for(host, path):
    best = None
    for rule, verdict in URL_RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def typed(path):
    path = re.sub(r"(?i)(?<![0-9a-z])[0-9a-f-]*[0-9][0-9a-f-]{7,}(?![0-9a-z])", "{x}", path)
    return tuple(s for s in re.sub("[0-9]+", "{n}", path).split("/") if s)


def brute(all_urls, most=24, weight=4.0):
    stats = defaultdict(lambda: [0, 0])
    for u in all_urls:
        host, path = parts(u)
        _, verdict = rule_for(host, path)
        x = stats[host, typed(path)]
        x[0] += verdict is not None
        x[1] += verdict == "block"
    template = dict.fromkeys(stats, "")
    for level in range(max(len(s) for _, s in stats)):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for (h, s), t in template.items():
            if len(s) > level:
                x = kids[h, t][s[level]]
                x[0] += stats[h, s][0]
                x[1] += stats[h, s][1]
        new = {}
        for (h, s), t in template.items():
            if len(s) <= level:
                new[h, s] = t
                continue
            group = kids[h, t]
            p = (sum(x[1] for x in group.values()) + 0.5) / (sum(x[0] for x in group.values()) + 1)
            l, b = group[s[level]]
            same = len(group) > most if l == 0 else abs(b / l - p) <= 2 * math.sqrt(p * (1 - p) / l)
            new[h, s] = t + "/" + ("*" if len(group) > 1 and same else s[level])
        template = new
    total = (sum(x[1] for x in stats.values()) + 0.5) / (sum(x[0] for x in stats.values()) + 1)
    across, own = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, s), (l, b) in stats.items():
        for x in (across[s], own[h, template[h, s]]):
            x[0] += l
            x[1] += b
    out = []
    for u in all_urls:
        host, path = parts(u)
        rule, verdict = rule_for(host, path)
        s = typed(path)
        prior = (across[s][1] + weight * total) / (across[s][0] + weight)
        l, b = own[host, template[host, s]]
        purity = (b + weight * prior) / (l + weight)
        out.append((host, path, rule, verdict or ("block" if purity >= 0.5 else "allow"), template[host, s]))
    return out


def made():
    rng = random.Random(3)
    hosts = ["a.example.com", "www.example.com", "example.com", "b.example.net", "c.example.org", "net", "xnet", "D.Example.NET", "hot.example.net"]
    found = []
    for i in range(3000):
        host = rng.choice(hosts) if i % 3 else "hot.example.net"
        path = rng.choice(["/en/", "/es/", "/fr/", "/de/", "/", "", "/en", "/EN/"]) + rng.choice(["", str(i), f"{i}.html", "deadbeef00112233/x", f"item-{i}/view", "/".join("abc"), rng.choice("abcdefghijklmnopqrstuvwxyz") + "q"])
        found.append(rng.choice(["http", "https"]) + "://" + host + path + rng.choice(["", "?a=/b", "#x/y", "?u=http://net/es/"]))
    return found + [None, "", "no scheme", "://", "a://b", "x\n://net/es/1", "http://a.example.com/en/1", "http://a.example.com/en/1"]


def test_against_brute_force(spark):
    data = made()
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(data)], "page_id long, url string, host string, path string")
    got = sorted(urls.judge_urls(spark, frame, URL_RULES).collect())
    assert [(r.host, r.path, r.rule, r.verdict, r.template) for r in got] == brute(data)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_unlabelled_branches_are_not_blocked_with_their_siblings(spark):
    for times in (1, 300):
        data = [f"http://a.example.net/{lang}/{k}" for lang in ("es", "fr", "de") for k in range(times)] + [f"http://b.example.com/de/{k}" for k in range(40)]
        frame = spark.createDataFrame([(i, u) for i, u in enumerate(data)], "page_id long, url string")
        got = {(r.host, r.path.split("/")[1], r.verdict) for r in urls.judge_urls(spark, frame, URL_RULES).collect()}
        assert got == {("a.example.net", "es", "block"), ("a.example.net", "fr", "block"), ("a.example.net", "de", "allow"), ("b.example.com", "de", "allow")}


def test_deep_and_lone_paths(spark):
    deep = "/".join(f"s{chr(97 + k % 26)}x" for k in range(300))
    data = [f"http://h/{deep}", "http://h/sax", "http://h/sax/q", "http://g//a//b/"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(data)], "page_id long, url string")
    got = sorted(urls.judge_urls(spark, frame, URL_RULES).collect())
    assert [r.template for r in got] == [f"/{deep}", "/sax", "/sax/q", "/a/b"] == [t for *_, t in brute(data)]


def test_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "http://net/es/1"), (None, None)], "page_id long, url string")
    assert sorted((r.rule or "", r.verdict) for r in urls.judge_urls(spark, frame, URL_RULES).collect())[1] == ("net/es/", "block")
    assert urls.judge_urls(spark, frame.limit(0), URL_RULES).count() == 0
