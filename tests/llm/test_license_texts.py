"""Whole licence texts, their neighbours, and the scan against a plain comparison of every template with every text."""

from __future__ import annotations

import random
import textwrap

from spanloom.llm import license_scan

FULL = [t for t in license_scan.TEMPLATES if t.endswith("-full")] + ["MPL-2.0", "LGPL-2.1", "AGPL-3.0"]


def test_whole_texts_wrapped_and_commented(spark):
    """Each text is reported once, under its own name, with no word missing, over its own lines only."""
    texts, want = [], []
    for name in FULL:
        for width, mark in ((78, ""), (60, " * "), (40, "# ")):
            body = textwrap.fill(license_scan.TEMPLATES[name], width, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False)
            texts.append(f"A tool for the rest of us.\n\n{body}\n\nUse it at the end of the day.")
            want.append((license_scan.license_of(name), 0, 0, body))
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], (r["license"], r["missing"], r["added"], texts[r["doc_id"]][r["start"] : r["stop"]])) for r in rows)
    assert got == list(enumerate(want))


def names(text: str) -> list[str]:
    return [hit[2] for hit in license_scan.Scanner(license_scan.TEMPLATES).match(license_scan.wording(text))]


def test_neighbours_differ_by_their_clauses():
    t = license_scan.TEMPLATES
    assert names(t["BSD-2-Clause-full"]) == ["BSD-2-Clause"] and names(t["BSD-3-Clause-full"]) == ["BSD-3-Clause"]
    assert names(t["ISC-full"]) == ["ISC"] and names(t["0BSD-full"]) == ["0BSD"]
    assert names(t["MPL-2.0"].replace("2.0", "1.1")) == []
    assert names(t["LGPL-2.1"].replace("2.1", "4.7")) == []
    assert names(t["AGPL-3.0"].replace("Affero", "Other")) == []
    assert names(t["MIT-full"] + "\n" + t["Zlib-full"] + "\n" + t["MIT-full"]) == ["MIT", "Zlib", "MIT"]


def plain(text: str) -> tuple | None:
    """(license, missing, added) of the template that stands best in the text: no word pairs, every template compared with the
    whole text, the saving taken over the stretch found and half a template around it."""
    scanner, words, found = license_scan.Scanner(license_scan.TEMPLATES), license_scan.wording(text), []
    for k, template in enumerate(scanner.words):
        missing, added, first, end = license_scan.align(words, template)
        slack = len(template) // 2 + 4
        data = " ".join(words[max(0, first - slack) : first + len(template) + 2 * slack]).encode()
        saved = (len(scanner.plain.compress(data)) - len(scanner.conditional[k].compress(data))) / scanner.own[k]
        rule = scanner.deciding[k]
        if saved >= license_scan.LEAST_SAVED and missing <= (1 - license_scan.LEAST_WORDS) * len(template) and (rule is None or rule.search(" ".join(words[first:end]))):
            found.append((missing - len(template), scanner.names[k], missing, added))
    return min(found)[1:] if found else None


def test_scan_equals_plain_compression_and_comparison():
    rng, scanner, seen = random.Random(11), license_scan.Scanner(license_scan.TEMPLATES), set()
    filler = "the of a tool and it is for people with no other word to do".split()
    for name in FULL + ["MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause"]:
        for loss in (0.0, 0.04, 0.1, 0.3, 0.5):
            words = [w for w in license_scan.TEMPLATES[name].split() if rng.random() >= loss]
            for _ in range(rng.randrange(3)):
                words.insert(rng.randrange(len(words)), rng.choice(filler))
            text = " ".join([*rng.choices(filler, k=9), *words, *rng.choices(filler, k=9)])
            hits = scanner.match(license_scan.wording(text))
            best = min(hits, key=lambda h: h[4] - (h[1] - h[0]), default=None)
            want = plain(text)
            assert (best and (best[2], best[4], best[5])) == want, (name, loss)
            seen.add((loss, want is None))
    assert {(0.0, False), (0.5, True)} <= seen  # both outcomes occur


def test_common_words_alone_are_no_licence():
    """Pairs that a template holds many times count once for each place of a text, and a text of such pairs has no licence."""
    assert names("of the software and the use of the software in the software " * 400) == []
