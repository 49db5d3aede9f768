"""Rules, parts and templates of urls."""

from newsloom.llm.queries import URL_RULES
from newsloom.llm.url_filter import url_filter

CASES = [
    ("http://A.Net/x", "a.net", "/x", "net/", "block"),
    ("https://net/", "net", "/", "net/", "block"),
    ("https://net", "net", "", None, "allow"),
    ("http://m.example.net/en/5?q=1", "m.example.net", "/en/5", "example.net/en/", "allow"),
    ("http://myexample.net/en/5", "myexample.net", "/en/5", "net/", "block"),
    ("http://example.com/de/#x", "example.com", "/de/", "example.com/de/", "block"),
    ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://x.org/FR/a", "x.org", "/FR/a", None, "allow"),
    ("http://x.org?u=http://y.net/", "x.org", "", None, "allow"),
    ("mailto:someone", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://Ä.net/ü", "Ä.net", "/ü", "net/", "block"),
    ("http://d.com/" + "/".join("abcdefghijklmnop"), "d.com", "/" + "/".join("abcdefghijklmnop"), None, "allow"),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "h", "p") for i, c in enumerate(CASES)] + [(None, "http://a.net/", "h", "p"), (0, "http://A.Net/x", "h", "p")], "page_id long, url string, host string, path string")
    found = url_filter(pages, URL_RULES).collect()
    assert len(found) == len(CASES) + 2
    for r in found:
        if r["page_id"] is not None:
            assert tuple(r[c] for c in ("host", "path", "rule", "verdict")) == CASES[r["page_id"]][1:]
    assert url_filter(pages.limit(0), URL_RULES).count() == 0


def test_templates_merge_and_are_judged(spark):
    rows = [f"http://s.com/user/{chr(97 + k % 26)}{chr(97 + k // 26)}x/photo" for k in range(60)]
    rows += [f"http://s.com/{lang}/{k}" for lang in ("en", "fr", "es") for k in range(40)]
    rows += [f"http://s.com/spam/{c}{chr(97 + k)}z" for c in "ab" for k in range(26)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter(pages, [("block", "s.com/spam/a")]).collect()}
    names = lambda part: {found[i]["template"] for i, u in enumerate(rows) if part in u}
    assert len(names("/user/")) == 1 and len(names("/spam/")) == 1 and len(names("/en/") | names("/fr/") | names("/es/")) == 1
    assert {found[i]["verdict"] for i, u in enumerate(rows) if "/spam/" in u} == {"block"}
    assert {found[i]["verdict"] for i, u in enumerate(rows) if "/spam/" not in u} == {"allow"}


def test_unlabelled_pages_are_rejected_and_repeats_change_nothing(spark):
    """Half of the slugs of a place are blocked: the others go too; a few blocked pages do not take a host with them."""
    rows = [f"http://s.com/spam/{c}{chr(97 + k)}z" for c in "ab" for k in range(26)]
    rows += [f"http://t.com/de/{k}" for k in range(4)] + [f"http://t.com/{lang}/{k}" for lang in ("en", "fr") for k in range(30)]
    rows += [f"http://u.com/{lang}/{k}" for lang in ("de", "en") for k in range(5)]
    rules = [("block", "s.com/spam/a"), ("block", "t.com/de/"), ("block", "u.com/de/")]
    seen = []
    for times in (1, 6):
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows) for _ in range(times)], "page_id long, url string")
        found = url_filter(pages, rules).collect()
        assert len(found) == times * len(rows)
        seen.append({r["page_id"]: (r["verdict"], r["template"], r["purity"], r["support"]) for r in found})
    assert seen[0] == seen[1]
    blocked = {u for i, u in enumerate(rows) if seen[0][i][0] == "block"}
    assert blocked == {u for u in rows if "s.com" in u or "u.com" in u or "/t.com/de/" in u}
    assert {seen[0][i][1] for i, u in enumerate(rows) if "u.com" in u} == {"/{0.4.0}/{n}"}
