import itertools
import random
import re

import numpy as np
import pytest

from botsift.llm import url_filter as uf

PAGES = [(1, "http://Shop.COM/a", "<p>cheap pills</p>"), (2, "https://www.example.com/en/1", "buy cheap pills"), (3, "http://blog.example.com/en/2", None), (4, "http://example.com/en/", ""),
         (5, "http://x.net/es/1?u=http://y.com/", "<script>cheap</script>pills"), (6, "http://x.net/de/1", "x"), (7, None, None), (8, "no scheme", "x"), (None, "http://a.com", "x"),
         (9, "http://com/", "x"), (10, "http://example.com#x/en/", "x"), (11, "http://cheappills.org/fr/1", "x"), (12, "http://m.cheappills.org/fr/1", "x"),
         (12, "http://m.cheappills.org/fr/1", "x"), (13, "://", "x"), (14, "a://b.net/fr/\nq", "x"), (15, "http://" + "ab" * 400 + ".org/", "x")]


def rule(host, path):
    best = None
    for h, p, v in uf.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def test_rules_and_parts(frame):
    rows = uf.filter_urls(frame(PAGES, "page_id long, url string, html string")).collect()
    assert len(rows) == len(PAGES)
    assert sorted(((r.page_id, r.host, r.path) for r in rows), key=str) == sorted(((i, *plain(u)) for i, u, _ in PAGES), key=str)
    for r in rows:
        fit = rule(r.host, r.path)
        assert (r.rule, r.log_odds is None) == ((fit[0], True) if fit else (None, False))
        assert r.verdict == fit[1] if fit else r.verdict in ("allow", "block")
    by = {r.page_id: r for r in rows}
    assert by[11].host_words == ["cheap", "pills", "org"] and by[12].host_words == ["m", "cheap", "pills", "org"]
    assert by[2].rule == "www.example.com/en/" and by[3].rule == by[4].rule == "example.com/en/" and by[5].rule == "net/es/"


def test_shuffled_weights_give_the_same(frame, monkeypatch):
    df = frame(PAGES, "page_id long, url string, html string")
    key = lambda rows: sorted(((r.page_id, r.url if "url" in r else r.host, r.verdict, round(r.log_odds or 0, 9)) for r in rows), key=str)
    one = key(uf.filter_urls(df).collect())
    monkeypatch.setattr(uf, "BROADCAST_ROWS", -1)
    assert key(uf.filter_urls(df).collect()) == one


def whole_by_hand(pages):
    """The whole result by plain Python: counts of all visible words, best cut of every label by trying all cuts, Bayes over tokens."""
    counts = {}
    for _, _, html in pages:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", html or "")
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[w] = counts.get(w, 0) + 1
    total = max(1, sum(counts.values()))

    def cost(word):
        n = counts.get(word, 0) if len(word) <= uf.LONGEST_WORD else 0
        return np.log(n / total) if n else np.log(10 / (total + 10)) - np.log(10) * len(word)

    def cut(label):
        cuts = []
        for marks in itertools.product((0, 1), repeat=len(label) - 1):
            words, word = [], label[0]
            for c, m in zip(label[1:], marks):
                if m:
                    words.append(word)
                    word = c
                else:
                    word += c
            cuts.append(words + [word])
        return max(cuts, key=lambda ws: sum(map(cost, ws)))

    def tokens(host, path):
        found = [f"host:{w}" for label in re.findall(r"[^\W\d_]+", host) for w in cut(label)]
        return found + [f"path:{'#' + str(len(t)) if t[0].isdigit() else t}" for t in re.findall(r"[^\W\d_]+|\d+", path.lower())]

    rows = [(i, *plain(u)) for i, u, _ in pages]
    seen = {"allow": {}, "block": {}}
    n = {"allow": 0, "block": 0}
    for _, host, path in rows:
        fit = rule(host, path)
        if fit:
            n[fit[1]] += 1
            for t in tokens(host, path):
                seen[fit[1]][t] = seen[fit[1]].get(t, 0) + 1
    names = set(seen["allow"]) | set(seen["block"])
    sums = {v: sum(seen[v].values()) + 0.5 * len(names) for v in seen}
    out = []
    for i, host, path in rows:
        fit = rule(host, path)
        odds = np.log(n["allow"] / n["block"]) + sum(
            np.log((seen["allow"].get(t, 0) + 0.5) / sums["allow"]) - np.log((seen["block"].get(t, 0) + 0.5) / sums["block"]) for t in tokens(host, path) if t in names)
        out.append((i, host, path, fit[0] if fit else None, fit[1] if fit else "allow" if odds >= 0 else "block", None if fit else round(float(odds), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 100_000])
def test_whole_result_by_hand(frame, hot):
    rng = random.Random(5)
    words = ["shop", "blog", "news", "pills", "cheap", "hop", "s", "log"]
    pages = []
    for i in range(150):
        label = "".join(rng.choices(words[:5], k=rng.randint(1, 2)))
        host = rng.choice([f"www.{label}.com", f"{label}.net", f"{label}.org", "www.example.com", "10.0.0.1"])
        path = "/" + "/".join(rng.choice(["fr", "es", "en", "a", "12", "345"]) for _ in range(rng.randint(0, 2)))
        pages.append((i, f"http://{host}{path}", " ".join(rng.choices(words, k=5)) + " averyveryverylongwordoftwentyonelettersandmore"))
    rows = uf.filter_urls(frame(pages, "page_id long, url string, html string"), hot_rows=hot).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, None if r.log_odds is None else round(r.log_odds, 6)) for r in rows), key=str)
    assert got == whole_by_hand(pages)


def test_bayes_by_hand(frame):
    pages = [(1, "http://good.com/aa", ""), (2, "http://good.com/aa", ""), (3, "http://bad.net/fr/zz", ""), (4, "http://good.org/aa", ""), (5, "http://bad.org/zz", "")]
    rows = {r.page_id: r for r in uf.filter_urls(frame(pages, "page_id long, url string, html string")).collect()}
    a = {"host:good": 2, "host:com": 2, "path:aa": 2}
    b = {"host:bad": 1, "host:net": 1, "path:fr": 1, "path:zz": 1}
    v = len(a) + len(b)
    for i, tokens in ((4, ["host:good", "path:aa"]), (5, ["host:bad", "path:zz"])):
        odds = np.log(2 / 1) + sum(np.log((a.get(t, 0) + 0.5) / (6 + 0.5 * v)) - np.log((b.get(t, 0) + 0.5) / (4 + 0.5 * v)) for t in tokens)
        assert rows[i].log_odds == pytest.approx(odds)
    assert rows[4].verdict == "allow" and rows[5].verdict == "block"


def test_viterbi_is_the_best_cut():
    counts = {"ab": 9, "a": 3, "bc": 4, "c": 2, "abc": 1}
    total = 30

    def cost(words):
        return sum(np.log(counts[w] / total) if w in counts else np.log(10 / (total + 10)) - np.log(10) * len(w) for w in words)

    for label in ("abc", "abcabc", "aabbcc", "zabz", "", "abzbc"):
        best = max((cost([label[i:j] for i, j in itertools.pairwise((0, *c, len(label)))]) for n in range(len(label)) for c in itertools.combinations(range(1, len(label)), n)), default=0)
        cut = uf.viterbi(label, counts, total)
        assert "".join(cut) == label and cost(cut) == pytest.approx(best)


def test_one_kind_of_rule_and_empty(frame):
    schema = "page_id long, url string, html string"
    assert uf.filter_urls(frame([], schema)).collect() == []
    assert {r.verdict for r in uf.filter_urls(frame([(1, "http://a.net/fr/x", ""), (2, "http://b.org/", "")], schema)).collect()} == {"block"}
    assert [r.verdict for r in uf.filter_urls(frame([(2, "http://b.org/", "")], schema)).collect()] == ["allow"]
