from __future__ import annotations

import hashlib
import random
import re
import time

from tessera.llm import pii


def brute(t: str) -> list[tuple[int, int, int]]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_by_brute_force():
    r = random.Random(1)
    for _ in range(6000):
        t = "".join(r.choice("0123456789.@+-() ab") for _ in range(r.randint(0, 90)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("4111 1111 1111 1111") == [(0, 19, 2)]
    for long in ("9" * 6000, "1." * 4000, "1.2.3.4" * 900, "4111 1111 1111 1111 " * 300, "+49 30 1234 5678, " * 300, "a@b.c" * 900):
        assert pii.base_spans(long) == brute(long)


def other_line(r: random.Random) -> tuple[str, set]:
    """Sentences that the training's generator can't make: names, sentences, log lines and forms of its own."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    first, last = r.choice(["maria", "john", "wei", "Olga", "pierre", "fatima", "k"]), r.choice(["garcia", "smith", "chen", "ivanova", "dupont", "okafor", "lee"])
    host, end = r.choice(["example", "mail", "uni-bonn", "acme-corp", "post", "school"]), r.choice(["com", "org", "net", "de", "edu", "fr"])

    def card() -> str:
        body = r.choice(["4", "51", "37"])
        body += n(15 - len(body))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    c = card()
    kind, s = r.choice([
        (0, f"{first} dot {last} at {host} dot {end}"), (0, f"{first} [at] {host} [dot] {end}"), (0, f"{first}.{last} @ {host}.{end}"), (0, f"{first}_{last}(at){host}.{end}"), (0, f"{first}{n(2)} at {host} dot {end}"),
        (1, f"2001:{r.randrange(4096):x}:{r.randrange(65536):x}::{r.randrange(256):x}"), (1, ":".join(f"{r.randrange(4096, 65536):x}" for _ in range(8))), (1, f"fe80::{r.randrange(256, 65536):x}:{r.randrange(65536):x}"),
        (2, f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"), (3, f"({n(3)}) {n(3)}-{n(4)}"), (3, f"0{n(3)} {n(3)} {n(4)}"), (3, f"{n(3)}-{n(3)}-{n(4)}"),
        (-1, f"on 19{n(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"), (-1, f"at {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}"), (-1, f"of {n(2)}.{n(2)} %"), (-1, ":".join(f"{r.randrange(256):02X}" for _ in range(6))), (-1, f"stay at {host}. {first.capitalize()} says"), (-1, f"v{n(1)}.{n(2)}.{n(1)}"), (-1, f"pages {n(3)}-{n(3)}"), (-1, f"std::{first.lower()}"),
    ])
    lead = {0: ["Please write to ", "Contact: ", "His address is "], 1: ["Connection from ", "The server ", "Ping to "], 2: ["He paid with card ", "VISA "], 3: ["Call us: ", "Tel. ", "My phone is "], -1: ["It was ", "Seen ", "The figure "]}[kind]
    text = r.choice(lead)
    gold = {(len(text), len(text) + len(s), kind)} if kind >= 0 else set()
    return text + s + r.choice([", thanks.", " and then we left.", "", "; see below"]), gold


def test_accuracy_on_lines_of_another_generator():
    w, r = pii.train(), random.Random(78)
    hit = extra = missed = 0
    for _ in range(1500):
        text, gold = other_line(r)
        got = set(pii.spans(text, w))
        hit, extra, missed = hit + len(got & gold), extra + len(got - gold), missed + len(gold - got)
    assert hit / (hit + extra) > 0.9 and hit / (hit + missed) > 0.9, (hit, extra, missed)


def test_held_out_accuracy():
    """Lines of the training's own generator that it wasn't trained on."""
    w, r = pii.train(), random.Random(77)
    hit = extra = missed = 0
    for _ in range(400):
        text, gold = pii.training_line(r)
        gold = gold | set(pii.base_spans(text))
        got = set(pii.spans(text, w))
        hit, extra, missed = hit + len(got & gold), extra + len(got - gold), missed + len(gold - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_best_path_by_enumeration():
    """The dynamic programme finds the best of all labellings: its score, and its places and types."""
    w = pii.train()
    texts = ("x 555 123 4567 2024", "4111 1111 1111 1111 12", "+1 (826) 555-4081 190.137.1", "a dot b at c dot com dot now", "10:22:2001:db8::1:2", "12.34.56.78.90 555 1234", "a at b at c.d.org")
    seen = 0
    for text in texts:
        for lattice in pii.lattices(text, []):
            seen += 1

            def paths(j, lattice=lattice):
                if j == 0:
                    yield -1, 0.0, ()
                for i, kind, features, a, b in lattice.edges[j]:
                    for last, score, spans in paths(i):
                        yield kind, score + pii._score(w, features) + w.get(f"{last}>{kind}", 0.0), spans + (((a, b, kind),) if kind >= 0 else ())

            found = list(paths(lattice.n))
            score, spans = pii.best_path(lattice, w)
            assert abs(score - max(f[1] for f in found)) < 1e-9 and tuple(spans) in {f[2] for f in found if f[1] > score - 1e-9}
            assert len({f[2] for f in found}) > 1
    assert seen >= len(texts)


def test_boundaries_are_chosen_by_the_field():
    w = pii.train()
    for text, want in {
        "write to john at example dot com today": ["john at example dot com"], "jane dot doe at mail dot example dot org dot": ["jane dot doe at mail dot example dot org"], "reach me john @ example . com now": ["john @ example . com"], "x 300.1.2.3.4 y": ["1.2.3.4"],
        "host 10:22:2001:db8::1 ok": ["2001:db8::1"], "MAC 00:1A:2B:3C:4D:5E up": [], "look at example.com for": [], "a at b at c dot com": ["b at c dot com"],
    }.items():
        assert [text[a:b] for a, b, _ in pii.spans(text, w)] == want, text


def test_long_texts_take_linear_time():
    """A megabyte of each; the bound leaves room for slow machines, but not for a square."""
    w = pii.train()
    for unit in ("a@b.cc at x dot com ", "a at b dot c ", "1:2:", "::1 ", "+1 ", "1.", "a(at)b.c(at)d.e", "4111 1111 1111 1111 "):
        took = []
        for size in (100_000, 1_000_000):
            text = unit * (size // len(unit))
            started = time.process_time()
            pii.spans(text, w)
            took.append(time.process_time() - started)
        assert took[1] < 25 * took[0] + 1, (unit, took)


def test_taken_places():
    r = random.Random(5)
    for _ in range(300):
        spans = [(a, a + r.randint(1, 6), 0) for a in (r.randrange(40) for _ in range(r.randint(0, 6)))]
        covered = {x for a, b, _ in spans for x in range(a, b)}
        taken = pii.Taken(spans)
        a, b = sorted((r.randrange(45), r.randrange(45)))
        if a < b:
            assert taken.free(a, b) == (not covered & set(range(a, b)))
            assert {x for s, e in taken.gaps(a, b) for x in range(s, e)} == set(range(a, b)) - covered


def test_gradient_is_that_of_the_likelihood():
    text, gold = "call 555 123 4567 on", {(5, 17, 3)}
    (lattice,) = pii.lattices(text, [])
    w = {"phone|": 0.3, "out": 0.1, "-1>3": 0.2}

    def likelihood(w):
        total, right = [], 0.0
        def paths(j):
            if j == 0:
                yield (-1, 0.0, ())
            for i, kind, features, a, b in lattice.edges[j]:
                for last, s, spans in paths(i):
                    own = ((a, b, kind),) if kind >= 0 else ()
                    yield kind, s + pii._score(w, features) + w.get(f"{last}>{kind}", 0.0), spans + own
        for _, s, spans in paths(lattice.n):
            total.append(s)
            if set(spans) == gold:
                right = s
        return right - pii._log_sum(total)

    g = pii.gradient(lattice, gold, w)
    for f in ("phone|", "out", "-1>3", "phone|digits 10"):
        near = {**w, f: w.get(f, 0.0) + 1e-5}
        assert abs((likelihood(near) - likelihood(w)) / 1e-5 - g[f]) < 1e-3, f


def test_numbers_run_together_are_told_apart():
    w = pii.train()
    text = "Des +1 (826) 555-4081 190.137.223.204 du"
    assert (4, 21, 3) in pii.spans(text, w) and (22, 37, 1) in pii.spans(text, w)
    assert not [s for s in pii.spans("by 0445617099674829 onor 2024-01-05 12:33", w)]
    assert pii.redacted("a b@c.de f", [(2, 8, 0)]) == "a [EMAIL] f"


def test_spelled_addresses_whatever_else_the_text_holds():
    w = pii.train()
    for s in ("name {at} host.org", "name[AT]host.org", "name (AT) host.com", "name at host Dot com", "name.42 at host.org"):
        for text in (f"write to {s}", f"an anecdote: write to {s}"):
            assert (len(text) - len(s), len(text), 0) in pii.spans(text, w), text
    for text in ("look at example.com for", "you are at risk.The next anecdote", "see file at index.html now"):
        assert pii.spans(text, w) == [], text


def test_compressed_addresses():
    w = pii.train()
    for s in ("2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:db8:85a3::8a2e:370:7334", "2001:db8:1:2::1", "2001:db8:1:2:3:4:5:6"):
        assert (5, 5 + len(s), 1) in pii.spans(f"from {s} on", w), s
    for text in ("call std::add or dead::beef", "x[1::2] and x[::2]", "at 12:30:45:10", "::ffff:1.2.3"):
        assert not [s for s in pii.spans(text, w) if s[2] == 1], text


def test_report_and_redaction_of_odd_rows(odd, none):
    rows = pii.report(odd).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    assert len(rows) == odd.count() and pii.report(none).count() == 0
    for r in rows:
        if r["doc_id"] is not None:
            base = brute(texts[r["doc_id"]])
            text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
            assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
            assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    clean = pii.redact(odd)
    assert clean.schema == odd.schema and clean.count() == odd.count()
    assert "example.org" not in "".join(r["text"] or "" for r in clean.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect() if r["text"] is not None and r["n_chars"] is not None)
