import ipaddress
import re

import pytest
from pyspark.sql import functions as F

import fixtures
from tallywatch.llm import surrogates as s

KEY = b"test key"
TEXT = ("Mail Hein.19@mail5.example.com, hein.19@MAIL5.example.com; +1 (743) 555-3824 or 743-555-3824. From 152.143.123.131, "
        "card 4111 1111 1111 1111 or 4111111111111111, 123-45-6789, Mrs. Anna Schmidt, Herr Schmidt, Госпожа Петрова, DE89370400440532013000")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000])
def test_permutation(size):
    assert sorted(s.permute(i, size, KEY, "t") for i in range(size)) == list(range(size))


def test_types_and_formats():
    kinds = [kind for *_, kind, _ in s.entities(TEXT)]
    assert kinds == ["email", "email", "phone", "phone", "ip", "card", "card", "ssn", "name", "name", "name", "iban"]
    card = s.surrogate("card", "4111111111111111", "", KEY)
    assert card[0] == "4" and s._luhn(card[:-1]) == int(card[-1]) and card != "4111111111111111"
    broken = s.surrogate("card", "4111111111111112", "", KEY)
    assert s._luhn(broken[:-1]) != int(broken[-1])
    iban = s.surrogate("iban", "DE89370400440532013000", "", KEY)
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert ipaddress.ip_address(s.surrogate("ip", "10.1.2.3", "", KEY)).is_private
    assert re.fullmatch("[А-яё]+", s.surrogate("name", "Петрова", "f/cyrillic", KEY))
    assert s.surrogate("name", "Anna Schmidt", "f/latin", KEY).split()[0] in s._GIVEN["latin", "f"]


def rewritten(spark, rows, **options):
    return {r.doc_id: r for r in s.replace_entities(fixtures.table(spark, rows), KEY, **options).collect()}


def test_mentions_keep_format_and_agree(spark):
    got = rewritten(spark, [(1, TEXT), (2, "again: HEIN.19@mail5.example.com and (743) 555-3824"), (3, "nothing here")])
    new = got[1].text
    for secret in ("Hein.19", "555-3824", "152.143.123.131", "4111 1111", "41111111", "123-45-6789", "Schmidt", "Петрова", "DE8937"):
        assert secret not in new
    mails = re.findall(r"\S+@\S+\.com", new) + re.findall(r"\S+@\S+\.com", got[2].text)
    assert len({m.lower() for m in mails}) == 1 and mails[0][0].isupper() and mails[2].split("@")[0].isupper()
    phones = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", new) + re.findall(r"\(\d{3}\) \d{3}-\d{4}", got[2].text)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "+1 (" in new
    cards = re.search(r"card ([\d ]{19}) or (\d{16})", new)
    assert cards[1].replace(" ", "") == cards[2]
    families = re.search(r"Mrs\. \w+ (\w+), Herr (\w+),", new)
    assert families[1] == families[2]
    assert got[3].text == "nothing here" and got[3].n_entities == 0


def test_collisions_draw_again(spark, monkeypatch):
    """A four-value format forces collisions; every entity still ends with its own surrogate."""
    rows = [("name", f"N{i}", "m/latin") for i in range(40)]
    real = s.surrogate
    monkeypatch.setattr(s, "surrogate", lambda kind, value, style, key, attempt=0: f"S{s._draw(key, value, attempt) % 60}")
    found = spark.createDataFrame(rows, "kind string, canonical string, style string")

    # The workers take the function from the closure of the task, so the small format is built in here.
    def assign(key):
        draw = s._draw

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                new = [f"S{int.from_bytes(__import__('hashlib').sha256(f'{r}{a}'.encode()).digest()[:4], 'big') % 60}"
                       for r, a in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new)], ["kind", "canonical", "style", "attempt", "surrogate"])
        return run if draw else None

    monkeypatch.setattr(s, "_assign", assign)
    got = s.assign_surrogates(found, KEY)
    assert got.count() == got.select("surrogate").distinct().count() == 40
    assert got.filter("attempt > 0").count() > 0
    monkeypatch.setattr(s, "surrogate", real)


def test_redrawn_entities_reach_the_texts(spark, monkeypatch):
    real = s.assign_surrogates

    def once_more(found, key):
        return real(found, key).withColumn("attempt", F.lit(3))

    monkeypatch.setattr(s, "assign_surrogates", once_more)
    got = rewritten(spark, [(1, "at 152.143.123.131"), (None, "card 4111111111111111"), (2, None)])
    assert got[1].text == "at " + s.surrogate("ip", "152.143.123.131", "", KEY, 3)
    assert got[None].text == "card " + s.surrogate("card", "4111111111111111", "", KEY, 3)
    assert got[2].text == ""


def test_edges(spark):
    got = s.replace_entities(fixtures.edge(spark), KEY).collect()
    assert len(got) == len(fixtures.EDGE_ROWS)
    assert {(r.doc_id, r.text) for r in got} == {(i, t or "") for i, t in fixtures.EDGE_ROWS}
    assert s.replace_entities(fixtures.empty(spark), KEY).count() == 0


def test_every_place_of_a_long_value_changes():
    """At each length from a few letters to far beyond one hash, no place keeps its letter under all keys."""
    for length in (*range(4, 60, 7), 80, 120, 250, 1000):
        text = ("abcdefghij" * length)[:length]
        changed = [False] * length
        for k in range(8):
            shaped = s._same_shape(text, f"key {k}".encode(), "mail")
            assert len(shaped) == length and shaped.isalpha()
            changed = [c or a != b for c, a, b in zip(changed, text, shaped, strict=True)]
        assert all(changed), length


def test_names_do_not_run_out(spark):
    """More single names than four syllables give: the losers take longer names, all distinct and none a real one."""
    names = spark.range(70_000).selectExpr("'name' AS kind", "concat('Имя', id) AS canonical", "'f/cyrillic' AS style")
    got = s.assign_surrogates(names, KEY)
    assert got.count() == 70_000 == got.select("surrogate").distinct().count()
    assert got.join(names.select("canonical"), got.surrogate == names.canonical).count() == 0
    lengths = {r.n for r in got.select(F.length("surrogate").alias("n")).distinct().collect()}
    assert min(lengths) == 8 and max(lengths) <= 8 + 2 * got.agg(F.max("attempt")).first()[0] <= 16


def test_a_key_is_required(spark):
    with pytest.raises(ValueError, match="key"):
        s.replace_entities(fixtures.edge(spark), b"")
