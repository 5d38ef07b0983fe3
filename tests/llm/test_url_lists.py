"""The list join against a loop over entries."""

import time
from datetime import datetime, timedelta

from tessera.llm import _common, url_lists

T0 = datetime(2024, 1, 1)


def brute(captures, entries):
    out = []
    for i, url, at in captures:
        active = []
        for key, category in {(e[0], e[1]) for e in entries if None not in e}:
            state, last = "remove", None
            for when, action in sorted((e[3], e[2]) for e in entries if None not in e and (e[0], e[1]) == (key, category)):
                if at is not None and when <= at:
                    state, last = action, when
            host_path = url.split("://", 1)[1].split("?")[0].split("#")[0].lower() if url and "://" in url else ""
            host = host_path.split("/")[0].split("@")[-1].split(":")[0].rstrip(".")
            path = host + "/" + "/".join(host_path.split("/")[1:])
            covers = (host == key or host.endswith("." + key)) if "/" not in key else (path == key or path.startswith(key + "/"))
            if state == "add" and covers and host and key and not key.endswith("/"):
                active.append((-len(key), category))
        best = min(active, default=(0, None))[1]
        out.append((i, url, at, len(active), best, best is not None and best != "allow"))
    return sorted(out, key=str)


def test_against_loop(spark, monkeypatch):
    day = timedelta(days=1)
    entries = [
        ("bad.example", "spam", "add", T0), ("bad.example", "spam", "remove", T0 + 40 * day), ("bad.example", "spam", "add", T0 + 45 * day),
        ("bad.example", "spam", "add", T0 + 45 * day), ("sub.bad.example", "adult", "add", T0 + 5 * day), ("bad.example/ok", "allow", "add", T0 + 2 * day),
        ("tie.example", "spam", "add", T0), ("tie.example", "spam", "remove", T0), (None, "spam", "add", T0), ("x.example", None, "add", T0), ("", "spam", "add", T0), ("bad.example/", "spam", "add", T0), ("bad.example//ok", "twice", "add", T0), ("example", "top", "add", T0), ("y.example", "spam", "add", None),
    ]
    urls = ["http://bad.example/", "https://u@sub.BAD.example.:8080/p?q", "http://bad.example/ok/a", "http://bad.example/okay", "http://bad.example//ok/b", "http://bad.example/ok/", "http://notbad.example/", "http://tie.example/", None, "", "no url", "http:///x"]
    captures = [(i * 10 + d, u, T0 + d * day) for i, u in enumerate(urls) for d in (0, 1, 3, 6, 40, 44, 45, 99)]
    captures += [(0, urls[0], None), captures[0], (None, urls[0], T0)]
    c = spark.createDataFrame([(*r, "x") for r in captures], "page_id long, url string, fetched_at timestamp_ntz, category string")
    e = spark.createDataFrame(entries, "key string, category string, action string, effective timestamp_ntz")
    for hot, most_keys in ((20_000, 100_000), (3, 0), (3, 100_000), (20_000, 0)):
        monkeypatch.setattr(_common, "HOT_ROWS", hot)
        got = sorted((tuple(r) for r in url_lists.judged(c, e, most_keys=most_keys).collect()), key=str)
        assert got == brute(captures, entries)
    assert url_lists.judged(c.limit(0), e).count() == 0
    assert url_lists.judged(c, e.limit(0)).where("blocked or n_active > 0").count() == 0


def test_long_histories_and_urls(spark):
    n, begun = 10_000, time.time()
    entries = [("host.example", "spam", "remove" if i % 2 else "add", T0 + timedelta(minutes=i)) for i in range(2 * n)]
    entries += [("host.example/a/a", "allow", "add", T0 + timedelta(minutes=n)), ("a.a.example", "spam", "add", T0)]
    captures = [(i, "http://host.example/a", T0 + timedelta(minutes=i, seconds=30)) for i in range(0, 2 * n, 7)]
    captures += [(-1, "http://host.example" + "/a" * 500_000, T0 + timedelta(minutes=n + 1)), (-2, "http://" + "a." * 200_000 + "example/", T0), (-3, "http://host.example/" + "/" * 1_000_000, T0)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz")
    e = spark.createDataFrame(entries, "key string, category string, action string, effective timestamp_ntz")
    got = {r["page_id"]: (r["n_active"], r["category"]) for r in url_lists.judged(c, e).collect()}
    want = {i: (1, "spam") if i % 2 == 0 else (0, None) for i in range(0, 2 * n, 7)}
    assert got == want | {-1: (1, "allow"), -2: (1, "spam"), -3: (1, "spam")}
    assert time.time() - begun < 180
