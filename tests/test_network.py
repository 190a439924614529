import ipaddress
import random

from vigilflow.functions.network import canonical_ip


def wanted(text):
    try:
        return str(ipaddress.ip_address(text.strip()))
    except ValueError:
        return None


def candidates():
    rng = random.Random(4)
    fixed = ["", "::", "::1", "1::", "1::2::3", ":1", "1:", ":::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1.2.3.4", "::ffff:1.2.3.4",
             "::FFFF:0102:0304", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5",
             " 10.0.0.1 ", "g::1", "12345::", "0:0:0:0:0:0:0:0", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "::1.2.3.256", "1.2.3.4::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "text"]
    for _ in range(600):
        groups = [rng.choice(["0", "0", "0", "00", "1", "a", "0db8", "FFFF", "10"]) for _ in range(rng.choice([2, 4, 6, 7, 8, 8, 8, 9]))]
        text = ":".join(groups)
        if rng.random() < 0.5:
            i = rng.randrange(len(groups))
            text = ":".join(groups[:i]) + "::" + ":".join(groups[i + rng.choice([0, 1]):])
        fixed.append(text)
    return fixed


def test_canonical_addresses(spark):
    rows = [(c, wanted(c)) for c in candidates()]
    df = spark.createDataFrame(rows, "a string, w string")
    wrong = [(r.a, r.w, r.g) for r in df.select("a", "w", canonical_ip("a").alias("g")).collect() if r.g != r.w]
    assert not wrong, wrong[:5]
