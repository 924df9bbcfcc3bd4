import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from clipledger.constants import BLOCKED_V4, BLOCKED_V6
from clipledger.functions.urls import clean_extension, media_extension
from clipledger.operators.policy import redirect_chain_audit, resolved_ip_audit, url_policy_audit
from clipledger.operators.text import extract_links, log_tail
from clipledger.sources.views import HOST_ALIASES


def links(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, body string")
    return [tuple(r) for r in extract_links(df, "id", "body").orderBy("id", "pos").collect()]


def test_all_host_aliases_fold_to_one_url(spark):
    got = links(spark, *(f"see https://{h}/jack/status/20 now" for h in HOST_ALIASES))
    assert len(got) == len(HOST_ALIASES) == 10
    assert {g[5] for g in got} == {"https://x.com/jack/status/20"}


@pytest.mark.parametrize(
    "text",
    ["https://X.COM/jack/status/20", "https://x.com/jack/STATUS/20", "https://x.com/user.name/status/20",
     "https://x.com/a_name_of_sixteen/status/1", "https://x.com/jack/status/", "https://example.com/jack/status/1",
     "https://x.com/jack/status/18446744073709551616", "https://x.com/jack/status/12३", None, ""],
)
def test_rejected_links(spark, text):
    assert links(spark, text) == []


def test_repeats_order_and_trimming(spark):
    got = links(
        spark,
        "(https://x.com/a/status/007?s=20) <https://x.com/a/status/7> https://x.com/b/status/18446744073709551615",
    )
    assert [(g[1], g[2], int(g[3])) for g in got] == [(0, "a", 7), (1, "a", 7), (2, "b", 18446744073709551615)]
    assert got[0][4] == "https://x.com/a/status/007" and got[0][5] == "https://x.com/a/status/7"


def test_extensions(spark):
    cases = [
        (".MP4", "mp4"), (" jpg ", "jpg"), ("png?size=large", "png"), ("../etc/passwd", "mp4"), ("", "mp4"), ("tar.gz", "mp4"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = {r.i: r.e for r in df.select("i", clean_extension(F.col("raw")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    urls = [
        ("image", "https://pbs.twimg.com/media/abc?format=png&name=small", "png"),
        ("gif", "https://video.twimg.com/clip", "gif"),
        ("video", "https://video.twimg.com/clip", "mp4"),
        ("photo", "https://pbs.twimg.com/x", "jpg"),
        ("image", "https://pbs.twimg.com/x?format=&FORMAT=Webp", "webp"),
        ("video", "https://h.example/v?file=.webm", "webm"),
    ]
    df = spark.createDataFrame(urls, "t string, u string, want string")
    for r in df.select("*", media_extension(F.col("t"), F.col("u")).alias("e")).collect():
        assert r.e == r.want, r


def test_url_policy(spark):
    cases = {
        "http://video.twimg.com/a": "non-https url",
        "https://localhost/a": "local hostname rejected",
        "https://printer.local/a": "local hostname rejected",
        "https://printer.lan./a": "local hostname rejected",
        "https://127.0.0.1/a": "ip literal rejected",
        "https://[::1]/a": "host not on allowlist",
        "https://example.com/a": "host not on allowlist",
        "https://eviltwimg.com/a": "host not on allowlist",
        "https://pbs.twimg.com:444/a": "port not allowed",
        "https://pbs.twimg.com/a": "ok",
        "https://VIDEO.twimg.com:8443/a": "ok",
        "https://new.twimg.com": "ok",
        "https://pbs.twimg.com@evil.com/": "host not on allowlist",
        "nonsense": "parse error",
        "https://pbs.twimg.com:99999/": "parse error",
        "https://bad host/": "parse error",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.reason for r in url_policy_audit(df).collect()} == cases


def test_blocked_addresses(spark):
    blocked = ["10.0.0.1", "127.9.9.9", "169.254.0.1", "172.16.0.1", "192.168.9.9", "224.0.0.1", "0.0.0.0",
               "255.255.255.255", "::1", "::", "::ffff:8.8.8.8", "::8.8.8.8", "fc00::1", "fdff::", "fe80::1", "febf::1", "ff02::1"]
    fine = ["1.1.1.1", "172.32.0.1", "11.0.0.0", "223.255.255.255", "2606:4700::1111", "fec0::1", "64:ff9b::808:808", "2001:db8:0:0:0:0:0:1"]
    df = spark.createDataFrame([(a, a) for a in [*blocked, *fine]] + [("none", None)], "url_id string, ip string")
    got = {r.url_id: r.reason for r in resolved_ip_audit(df).collect()}
    assert {a for a in got if got[a] == "resolved to blocked ip"} == set(blocked)
    assert {a for a in got if got[a] == "ok"} == set(fine)
    assert got["none"] == "dns lookup returned no addresses"


def test_spellings_of_addresses(spark):
    """Whatever is read agrees with the standard library, and the rest is unreadable."""
    rnd, texts = random.Random(2), {"1:2:3", "1:2:3:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::8", "1:2:3:4:5:6:1.2.3.4", "::", ":", "1::", "::1.2.3.4", "1.2.3.4:"}
    for _ in range(1500):
        groups = [rnd.choice(["0", "a", "FFFF", "12", "01b", "fe80", "12345", "g", ""]) if rnd.random() < 0.15 else format(rnd.randrange(65536), "x") for _ in range(rnd.choice([2, 3, 6, 7, 8, 8, 8, 9]))]
        if rnd.random() < 0.5:
            groups[rnd.randrange(len(groups))] = ""
        if rnd.random() < 0.3:
            groups[-1] = rnd.choice(["1.2.3.4", "10.0.0.1", "1.2.3", "256.1.1.1", "01.2.3.4"])
        text = ":".join(groups)
        texts |= {text, text.replace("::", ":"), ":" + text, text + ":"}
    def fine(text):
        try:
            ipaddress.ip_address(text)
        except ValueError:
            return False
        return True
    texts = sorted(texts)
    df = spark.createDataFrame([(t, t) for t in texts], "url_id string, ip string")
    got = {r.url_id: r.reason for r in resolved_ip_audit(df).collect()}
    assert {t for t in texts if got[t] != "unreadable ip"} == {t for t in texts if fine(t)}
    for t in filter(fine, texts):
        nets = [ipaddress.ip_network(n) for n in (*BLOCKED_V4, *BLOCKED_V6)]
        assert (got[t] == "ok") == (not any(ipaddress.ip_address(t) in n for n in nets)), t


def test_thousands_of_ranges(spark):
    """Ranges of any length come from a table; the plan has a join for each length, not for each range."""
    rnd = random.Random(4)
    nets = {ipaddress.ip_network((rnd.getrandbits(32), bits), strict=False) for bits in (0, 9, 16, 23, 32) for _ in range(800 if bits > 9 else bits // 9)}
    nets |= {ipaddress.ip_network((rnd.getrandbits(128), bits), strict=False) for bits in (3, 32, 61, 128) for _ in range(300 if bits > 3 else 2)}
    nets.discard(ipaddress.ip_network("0.0.0.0/0"))
    asked = [str(next(iter(n.hosts()), n[0])) for n in rnd.sample(sorted(nets, key=str), 300)] + [str(ipaddress.ip_address(rnd.getrandbits(32))) for _ in range(300)]
    df = spark.createDataFrame([(a, a) for a in asked], "url_id string, ip string")
    rules = spark.createDataFrame([(str(n),) for n in nets], "cidr string")
    audited = resolved_ip_audit(df, rules=rules)
    got = {r.url_id: r.reason != "ok" for r in audited.collect()}
    assert got == {a: any(ipaddress.ip_address(a) in n for n in nets if n.version == ipaddress.ip_address(a).version) for a in asked}
    assert audited._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == len({(n.version, n.prefixlen) for n in nets})
    for wrong in ("10.0.0.0/33", "1:2:3/8", "10.0.0.0", "x/1"):
        with pytest.raises(ValueError, match=wrong):
            resolved_ip_audit(df, rules=rules.limit(1).unionByName(spark.createDataFrame([(wrong,)], "cidr string")))


def test_redirects(spark):
    ok = "https://pbs.twimg.com/"
    rows = [("five", h, ok, 302, ok) for h in range(5)] + [("five", 5, ok + "end", 200, None)]
    rows += [("six", h, ok, 302, ok) for h in range(6)] + [("six", 6, ok, 200, None)]
    rows += [("lost", 0, ok, 302, None), ("cut", 0, ok, 302, ok), ("bad", 0, ok, 302, ok), ("bad", 1, "https://a.lan/", 200, None)]
    df = spark.createDataFrame(rows, "req string, hop bigint, url string, status int, location string")
    got = {r.req: (r.n_hops, r.final_url, r.reason) for r in redirect_chain_audit(df).collect()}
    assert got == {
        "five": (6, ok + "end", "ok"), "six": (6, None, "too many redirects"),
        "lost": (1, None, "redirect missing location header"), "cut": (1, None, "incomplete"),
        "bad": (2, None, "local hostname rejected"),
    }


def test_log_tail(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", "", "b", "c"])] + [(2, 0, "é" * 3000)]
    df = spark.createDataFrame(rows, "proc int, line_no int, text string")
    got = {r.proc: (r.tail, r.truncated) for r in log_tail(df, 3).collect()}
    assert got[1] == ("\nb\nc", True)
    assert got[2] == ("é" * 2048, False)
    odd = spark.createDataFrame([(1, 0, "x" + "é" * 3000)], "proc int, line_no int, text string")
    assert log_tail(odd).first().tail == "x" + "é" * 2047 + "�"
