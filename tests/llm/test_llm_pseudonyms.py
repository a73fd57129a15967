import hashlib
import re
from datetime import datetime
from functools import reduce

import pytest
from candlemill.llm.pseudonyms import pseudonymise
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from text_helpers import clash, docs, odd_rows

KEY = "a key"


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def slow_feistel(left, right, a, b, tweak):
    for i in range(8):
        half = right if i % 2 == 0 else left
        h = int(hashlib.sha256(f"{KEY}:{tweak}:{a}:{b}:{i}:{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + h % a) % a
        else:
            right = (right + h % b) % b
    return left, right


def run(spark, *found, key=KEY):
    rows = pseudonymise(docs(spark, list(enumerate(found))), key).sort("doc_id").collect()
    return [r.text for r in rows]


def card(n):
    body = str(n * 7919 + 4_000_000_000_000_00)[:15]
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def test_formats_stay_valid(spark):
    values = {
        "card": ([card(i) for i in range(30)], lambda x: re.fullmatch(r"\d{16}", x) and luhn(x)),
        "ip": ([f"{i}.20.{3 * i}.{255 - i}" for i in range(1, 40)], lambda x: re.fullmatch(r"(\d+\.){3}\d+", x) and max(map(int, x.split("."))) < 256),
        "date": ([f"20{i:02}-02-1{i % 10}" for i in range(40)], lambda x: datetime.strptime(x, "%Y-%m-%d")),
        "dotted": ([f"1{i % 10}.0{1 + i % 9}.19{i + 10}" for i in range(40)], lambda x: datetime.strptime(x, "%d.%m.%Y")),
        "ssn": ([f"{101 + i}-{10 + i}-{2000 + i}" for i in range(30)], lambda x: re.fullmatch(r"\d{3}-\d{2}-\d{4}", x)),
        "phone": ([f"+1 (2{i:02}) 555-12{i:02}" for i in range(30)], lambda x: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x)),
        "email": ([f"Jo.{i}_ü@mail{i}.example.com" for i in range(30)], lambda x: re.fullmatch(r"[A-Z][a-z]\.\d+_[à-ÿ]@mail\d+\.example\.com", x)),
        "secret": ([hashlib.sha1(bytes([i])).hexdigest() for i in range(30)], lambda x: re.fullmatch(r"[0-9a-f]{40}", x)),
    }
    for kind, (old, right) in values.items():
        new = run(spark, *(f"so: {v}, then" for v in old))
        new = [re.fullmatch(r"so: (.*), then", x)[1] for x in new]
        assert all(right(x) for x in new), (kind, new)
        assert sum(a == b for a, b in zip(old, new)) <= 1 and len(set(new)) == len(set(old)), kind


def test_equal_values_stay_linked_in_any_format_and_text(spark):
    c = card(5)
    spaced = " ".join(c[i:i + 4] for i in range(0, 16, 4))
    a, b, d, e = run(spark, f"x {c} y", f"{spaced}, and {c}!", "(212) 555-0100", "call 212-555-0100 or +1 (212) 555-0100.")
    new = re.search(r"\d{16}", a)[0]
    assert re.sub(r"\D", "", b) == new * 2 and b[4] == " " and b.endswith("!")
    assert re.findall(r"\d", e)[:10] == re.findall(r"\d", d) and re.sub(r"\D", "", e)[11:] == re.sub(r"\D", "", d)
    assert run(spark, c, key="other") != run(spark, c)


def test_against_a_plain_network(spark):
    c = card(9)
    left, right = slow_feistel(int(c[:7]), int(c[7:15]), 10**7, 10**8, "card")
    assert run(spark, c)[0][:15] == f"{left:07}{right:08}"
    ip = run(spark, "10.20.30.40")[0].split(".")
    left, right = slow_feistel(10 * 256 + 20, 30 * 256 + 40, 65536, 65536, "ip")
    assert list(map(int, ip)) == [left // 256, left % 256, right // 256, right % 256]


@pytest.mark.parametrize("text", [
    "1234567890123456", "300.1.2.3", "1.2.3.4.5", "2023-02-30", "31.04.2020", "000-12-3456", "version 2.0", "a@b", "@home", "12345", "", "no digits",
    "2020-13-01", "666-12-3456", "deadbeef"])
def test_what_fails_validation_stays(spark, text):
    found = pseudonymise(docs(spark, [(1, text)]), KEY).first()
    assert (found.text, found.n_pseudonyms) == (text, 0)


def test_a_card_beside_other_numbers(spark):
    c = card(5)
    spaced, dashed = (sep.join(c[i:i + 4] for i in range(0, 16, 4)) for sep in " -")
    new = run(spark, c)[0]
    new_spaced, new_dashed = (sep.join(new[i:i + 4] for i in range(0, 16, 4)) for sep in " -")
    ip, date = run(spark, "10.20.30.40", "12/25/2020")
    cases = {}
    for old, out in ((c, new), (spaced, new_spaced), (dashed, new_dashed)):
        cases |= {f"{old} {x}": f"{out} {x}" for x in ("12/26", "123", "1", "7 8")}
        cases |= {f"{x} {old}": f"{x} {out}" for x in ("2", "12", "123", "1234", "12/26", "7 8")}
        cases |= {f"{old} 10.20.30.40": f"{out} {ip}", f"10.20.30.40 {old}": f"{ip} {out}"}
        cases |= {f"{old} 12/25/2020": f"{out} {date}", f"12/25/2020 {old}": f"{date} {out}"}
    cases |= {f"{x} 10.20.30.40": f"{x} {ip}" for x in ("1234567890123456", "1234 5678 9012 3456")}
    cases |= {f"{spaced} {spaced} 2024": f"{new_spaced} {new_spaced} 2024"}
    assert dict(zip(cases, run(spark, *cases))) == cases


def test_odd_rows(spark):
    table = clash(docs(spark, [*odd_rows(), (77, f"{card(1)} {card(2)}\n{card(1)}")]), "_old", "_new", "_found", "n_pseudonyms", "m")
    found = pseudonymise(table, KEY)
    assert found.columns == table.columns
    out = found.collect()
    assert {(r["_old"], r["_new"], r["_found"]) for r in out} == {("own _old", "own _new", "own _found")}
    assert len(out) == len(odd_rows()) + 1 and {r["m"] for r in out} == {"own m"}
    by = {r.doc_id: r for r in out}
    assert by[1].text is None and by[1].n_pseudonyms == 0 and by[77].n_pseudonyms == 3
    assert by[6].text == odd_rows()[6][1]
    assert pseudonymise(docs(spark, []), KEY).count() == 0


def test_dates_are_one_to_one(spark):
    """Every date of two centuries in every form: no two meet, each stays a date of its form, and forms stay linked."""
    days = spark.range(73_049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    for forms, distinct in ((["yyyy-MM-dd"], 73_049), (["dd/MM/yyyy", "MM/dd/yyyy"], 2 * 73_049 - 28_800)):
        texts = reduce(DataFrame.union, [days.select(F.date_format("day", f).alias("text")) for f in forms]).distinct()
        rows = pseudonymise(texts.withColumn("old", F.col("text")).repartition(8), KEY).select("old", "text").collect()
        assert len(rows) == len({r.text for r in rows}) == distinct == len({r.old for r in rows} & {r.text for r in rows})
        if len(forms) > 1:  # in the same class: what can be read both ways, day first alone, month first alone
            kind = lambda x: (int(x[:2]) > 12, int(x[3:5]) > 12)
            assert all(kind(r.old) == kind(r.text) for r in rows)
    iso, dotted, slashes = run(spark, "2020-02-29", "29.02.2020", "2020/02/29")
    assert iso == "-".join(reversed(dotted.split("."))) == slashes.replace("/", "-")


def test_social_security_numbers_stay_valid(spark):
    old = [f"{a:03}-{g:02}-{s:04}" for a in range(1, 900, 3) if a != 666 for g in (1, 50, 99) for s in (1, 9999)]
    new = run(spark, *old)
    assert len(set(new)) == len(old)
    assert all(x[:3] not in ("000", "666") and x[:3] < "900" and x[4:6] != "00" and x[7:] != "0000" for x in new)
