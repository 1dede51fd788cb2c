import itertools
import random
import re

from lectern.llm.license_scan import TEMPLATES, Automaton, LicenseConfig, LicenseMatcher, places, scan_licenses
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def readings(parts):
    """Every word sequence of a small template, with v for a replaceable word."""
    options, k = [], 0
    while k < len(parts):
        if parts[k] == "<<opt>>":
            depth, end = 1, k
            while depth:
                end += 1
                depth += {"<<opt>>": 1, "<<end>>": -1}.get(parts[end], 0)
            options.append([[], *readings(parts[k + 1 : end])])
            k = end
        elif parts[k].startswith("<<var"):
            most = int(parts[k][6:-2])
            options.append([["v"] * n for n in (range(most + 1) if most < 4 else (0, 1, most))])
        else:
            options.append([[parts[k]]])
        k += 1
    return [list(itertools.chain(*x)) for x in itertools.product(*options)]


def test_automata_accept_every_reading():
    for label, template in TEMPLATES:
        automaton = Automaton(label, template)
        for words in readings(template.split()):
            raw = [w.encode() for w in words]
            assert automaton.match([*raw, b"zzz"], 0) >= len(raw) - 1 and automaton.match(raw, 0) == len(raw), (label, words)
            for k, w in enumerate(words):
                if words.count(w) == 1 and w.encode() in automaton.mandatory:
                    assert automaton.match([*raw[:k], b"qqq", *raw[k + 1 :]], 0) < len(raw)


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_license_scan"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "CC BY cc-by ALL RIGHTS RESERVED, all rights reserved"), (None, "ccé by"), (4, "word " * 100_000 + "Licensed under CC BY-NC 4.0."), (5, "licensed under the Apache licence, version 2.0"), (5, "x")]
    rows = scan_licenses(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, labels string")).collect()
    assert len(rows) == len(docs)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr) == sorted(((d, *brute(t)) for d, t in docs), key=repr)
    assert {r.doc_id: r.labels for r in rows}[4] == "cc-by,cc-by-nc"
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_optional_and_replaceable_regions():
    matcher = LicenseMatcher(LicenseConfig(templates=(("t", "start <<opt>> maybe <<end>> <<var:2>> stop"),)))
    assert matcher.report("start stop")[5] == "t" and matcher.report("start maybe a b stop")[5] == "t"
    assert matcher.report("start a b c stop")[5] == ""
    assert places([b"a", b"a", b"a"], [b"a", b"a"]) == [0, 1]


def pattern(template):
    """The template as a regular expression over words that each end with a blank."""
    out = ""
    for part in template.split():
        out += {"<<opt>>": "(?:", "<<end>>": ")?"}.get(part) or (f"(?:[^ ]+ ){{0,{part[6:-2]}}}" if part.startswith("<<var") else re.escape(part) + " ")
    return re.compile(out)


PATTERNS = [(label, pattern(t), sum(not p.startswith("<<") for p in t.split())) for label, t in TEMPLATES]


def whole(text):
    """Labels and score by regular expressions; of each start the longest run, runs of one template apart."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = brute(text)[4]
    labels, score = set(filter(None, base.split(","))), 0.5 if base else 0.0
    for label, p, size in PATTERNS:
        k = 0
        while k < len(words):
            if not p.match("".join(f"{w} " for w in words[k : k + 400])):
                k += 1
                continue
            end = next(e for e in range(min(len(words), k + 400), k, -1) if p.fullmatch("".join(f"{w} " for w in words[k:e])))
            labels.add(label)
            score = max(score, 0.5 + 0.5 * min(1.0, (end - k) / size))
            k = end
    return ",".join(sorted(labels)), round(score, 9)


def test_labels_and_scores_against_regular_expressions():
    rng, matcher = random.Random(6), LicenseMatcher(LicenseConfig())
    filled = lambda t: " ".join(" ".join(rng.choices(["anna", "inc", "2019"], k=rng.randrange(int(p[6:-2]) + 1))) if p.startswith("<<var") else "" if p.startswith("<<") else p for p in t.split())
    for n in range(400):
        text = " ".join(rng.choice([filled(rng.choice(TEMPLATES)[1]), "some words", "Licensed under", "mit license", "all rights reserved", "copyright", "2 0"]) for _ in range(rng.randrange(1, 5)))
        if n % 3 == 0:
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        report = matcher.report(text)
        assert (report[5], round(report[6], 9)) == whole(text), text


def test_whole_wording_is_asked_for():
    matcher = LicenseMatcher(LicenseConfig())
    mit, bsd = TEMPLATES[0][1], TEMPLATES[1][1]
    full = re.sub(r"<<[^>]*>>", "", mit)
    assert matcher.report(full)[5] == "mit" and matcher.report(full.replace("sublicense", "lease"))[5] == ""
    assert matcher.report(full[:700])[5] == "" and matcher.report(" ".join(bsd.split()[:22]))[5] == ""
    regents = "Copyright (c) 1992, 1993 The Regents of the University of California. All rights reserved."
    assert matcher.report(regents)[5] == "notice,reserved"


def test_mentions_and_clauses_are_told_apart():
    matcher = LicenseMatcher(LicenseConfig())
    labels = lambda text: matcher.report(text)[5]
    assert labels("This file is not under the MIT license and must not be used.") == "mit-mention"
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache-2.0-mention"
    assert labels("It used to be under the 3-clause BSD license.") == "bsd-mention"
    of = {label: re.sub(r"<<[^>]*>>", "", t) for label, t in TEMPLATES}
    assert labels(of["apache-2.0"]) == "apache-2.0,apache-2.0-mention"
    assert labels(of["apache-2.0"].replace("governing", "about")) == "apache-2.0-mention"
    assert labels(of["bsd-2-clause"]) == "bsd-2-clause" and labels(of["bsd-3-clause"]) == "bsd-3-clause"
    assert labels(of["bsd-3-clause"].replace("endorse", "praise")) == ""
    assert labels("Copyright " + "some name " * 20 + "All rights reserved") == "notice,reserved"
    assert labels("Copyright " + "some name " * 21 + "All rights reserved") == "reserved"
