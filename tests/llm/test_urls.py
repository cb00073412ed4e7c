import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from copse.llm.url_automaton import RULES, Automaton, split, url_verdicts


def as_regex(glob):
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", glob, re.S))
    return re.compile(out.encode() if False else out, re.S)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/.*?", max_size=8), min_size=1, max_size=30), st.lists(st.text("ab/.", max_size=12), min_size=1, max_size=24))
def test_automaton_is_glob_matching(globs, texts):
    fits = Automaton.of(globs).run([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert fits[i].tolist() == [as_regex(g).fullmatch(t) is not None for g in globs]


def test_very_long_urls():
    machine = Automaton.of(["**/ads/**", "*.org/**", "?" * 70 + "**"])
    long = [b".x.org/" + b"q" * 1_000_000 + b"/ads/" + b"r" * 50_000, b".x.com/" + b"q/" * 500_000, b"a" * 69, b"", b"b" * 71]
    for texts in (long, long + [b".y.org/"] * 40):
        fits = machine.run(texts)
        assert fits[:5].tolist() == [[True, True, False], [False, False, False], [False, False, False], [False, False, False], [False, False, True]]
        assert all(f == [False, True, False] for f in fits[5:].tolist())


def judge(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(r), r, v) for v, r in RULES for h, s, q in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + q)]
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict
    return host, path, None, "block" if "/ads/" in path or "/login" in path else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://x.org/y?z", "https://a.example.org/es/1", "https://example.org/en/12#f", "http://notexample.org/en/1", "ftp://x.com/fr/a", "http://x.com/de/", "http://x.com/de", "http://xcom/de/", "http://x.net/ads/1", "http://x.net/a/login?x", "http://x.net?/ads/", "a://b://org/", "http://x.com/org/", "http://É.ORG/É", "http://x.org:80/", "http://x.org/" + "q" * 20000, "://.org/"]
    rng = random.Random(1)
    urls += ["http://" + "".join(rng.choice(["org", "com", "example", ".", "/", "en", "es", "de", "fr", "1", "?", "#"]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    rows = [(i if i else None, u, "x", "y") for i, u in enumerate(urls)] + [(5, urls[5], "x", "y")]
    got = sorted(map(tuple, url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()), key=repr)
    assert got == sorted(((i, *judge(u)) for i, u, _, _ in rows), key=repr)
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert split("HTTP://A.b/C#?") == ("a.b", "/C")
