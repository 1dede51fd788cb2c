import random
import re

from lectern.llm.decontaminate import DecontaminationConfig, canonical, contaminated
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
D, B = "doc_id long, text string, item_id string", "item_id long, text string"
ITEM = "A train leaves Paris at 9 and travels 120 km at a steady speed before Anna counts 9 bridges. How many minutes does the trip of 120 km take?"
MOVED = "First. A train leaves Lyon at 7 and travels 350 km at a steady speed before Anna counts 7 bridges. How many minutes does the trip of 350 km take? Last."
BROKEN = "First. A train leaves Lyon at 7 and travels 350 km at a steady speed before Anna counts 8 bridges. How many minutes does the trip of 99 km take? Last."


def found(spark, docs, bench, cfg=DecontaminationConfig()):
    rows = contaminated(spark.createDataFrame([(*d, "clash") for d in docs], D), spark.createDataFrame(bench, B), cfg).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_reparameterised_questions(spark):
    filler = "other words stand here " * 50
    hits = found(spark, [(1, filler + ITEM), (2, filler + MOVED), (3, BROKEN), (4, filler)], [(7, ITEM)])
    assert set(hits) == {(1, 7), (2, 7)}
    assert hits[1, 7].exact and not hits[2, 7].exact
    assert hits[1, 7].start == 200 and hits[1, 7].windows == hits[1, 7].of


def test_all_verbatim_passages(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(t.lower().split())
    expected = {(d.doc_id, b.item_id) for d in docs for b in bench if plain(b.text) in plain(d.text)}
    assert expected
    assert {(r.doc_id, r.item_id) for r in QUERIES["op5_decontaminate"](spark, SF).collect()} == expected


def test_short_items_and_odd_rows(spark):
    docs = [(1, "say alpha beta gamma delta epsilon zeta now"), (2, "alpha beta"), (3, "we alpha beta here"), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9"), (None, ITEM), (8, "word " * 100_000 + ITEM), (8, "word " * 100_000 + ITEM)]
    bench = [(1, "Alpha beta gamma delta epsilon zeta"), (2, "alpha beta"), (3, None), (4, ""), (5, "9 8 7 6 5 4 3 2 1"), (None, "alpha beta"), (6, ITEM), (6, ITEM)]
    assert set(found(spark, docs, bench)) == {(1, 1), (1, 2), (2, 2), (3, 2), (8, 6)}
    assert found(spark, [], bench) == {} and found(spark, docs, []) == {}


def test_templates():
    t = canonical("We ran 5 km with Bob. Bob ran 3.")
    assert t.slots(0, len(t.hashes)) == ["num:5", "unit:km", "name:bob", "num:3"]
    assert len(canonical("").hashes) == 0


def test_changed_and_partial_copies(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]
    middle, short = words[:39], words[40:60]
    filler = "other words stand here " * 20
    texts = [
        middle[:20] + ["new"] + middle[20:], middle[:20] + middle[21:], middle[:19] + ["new"] + middle[20:], short[:10] + ["new"] + short[11:],
        words[:50], middle[:13], middle[:12], middle[:6] + ["new"] + middle[6:12], middle[20:30] + middle[:10],
    ]
    docs = [(k, filler + " ".join(t) + " " + filler) for k, t in enumerate(texts)]
    hits = found(spark, docs, [(1, " ".join(middle)), (2, " ".join(short)), (3, " ".join(words))])
    assert {0, 1, 2, 4, 5} <= {d for d, i in hits if i == 1} and {d for d, i in hits if i == 2} == {3}
    assert (4, 3) in hits and not {6, 7, 8} & {d for d, _ in hits}
    assert hits[0, 1].windows == 25 and hits[0, 1].start == 80


def test_texts_of_one_id_stay_apart(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(24)]
    docs = [(1, " ".join(words[:12])), (1, " ".join(["x"] * 12 + words[12:])), (2, " ".join(words[:12] + ["x"] + words[12:]))]
    assert set(found(spark, docs, [(1, " ".join(words))])) == {(2, 1)}


def test_items_poor_in_words_and_values_that_meet(spark):
    apples = "Tom has 3 apples and buys 4 pears at the market before lunch. How many fruits does Tom have now?"
    docs = [(1, "What is 345 times 22?"), (2, "Solve it: what is 345 times 22? Then rest."), (3, "What is 346 times 22?"), (4, apples.replace("3", "5").replace("4", "5"))]
    hits = found(spark, docs, [(1, "What is 345 times 22?"), (2, apples)])
    assert set(hits) == {(1, 1), (2, 1), (4, 2)}
    assert hits[1, 1].exact and not hits[4, 2].one_to_one and hits[1, 1].one_to_one


def test_case_and_what_stands_before(spark):
    names = "Anna Miller met Bob Stone, Carl Young and Dora Frost in Paris while Emil Gold paid 12 euros to Fred Hill there."
    france = "What is the capital of France?"
    docs = [(1, f"Question: {france}"), (2, f"- {france}"), (3, f"he asked {france.upper()}"), (4, f"x {names.lower()}"), (5, f"x {names.upper()}"), (6, f"Note: {MOVED[7:]}"), (7, f"x {MOVED[7:].lower()}")]
    hits = found(spark, docs, [(1, france), (2, names), (3, ITEM)])
    assert set(hits) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3)}
    assert hits[4, 2].windows == hits[4, 2].of and hits[4, 2].exact


def tokens(text):
    """(token, kind) by the rules of the templates: num, name, or a word; names don't begin a sentence."""
    out, stop = [], True
    for t in re.findall(r"[^\W\d_]+|\d+|[.!?]", text):
        if t in ".!?":
            stop = True
            continue
        out.append((t.lower(), "num" if t.isdigit() else "name" if not stop and len(t) > 1 and t[0].isupper() and t[1:].islower() else "word"))
        stop = False
    return out


def straight(item, text, width=8, share=0.5, run=13):
    """Whether an unbroken passage of the item stands in the text: every alignment, token by token."""
    a, b = tokens(item), tokens(text)
    full = len(a) - width + 1
    for shift in range(-len(a) + 1, len(b)):
        k = max(0, -shift)
        while k < len(a) and k + shift < len(b):
            end = k
            while end < len(a) and end + shift < len(b) and (a[end][0] == b[end + shift][0] or a[end][1] == b[end + shift][1] != "word"):
                end += 1
            own = {}
            agreed = all(own.setdefault(x, y[0]) == y[0] for x, y in zip(a[k:end], b[k + shift : end + shift]) if x[1] != "word")
            if agreed and (end - k >= run or end - k - width + 1 >= max(1, full * share)):
                return True
            k = max(end, k + 1)
    return False


def test_straight_passages_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    names = ["Anna", "Carl", "Dora", "Emil", "Otto"]
    items = []
    for n in range(30):
        body = [rng.choice(words) for _ in range(rng.choice([9, 12, 18, 24]))]
        for k in rng.sample(range(1, len(body)), 3):
            body[k] = rng.choice([str(rng.randrange(3, 9)), rng.choice(names)])
        items.append((n, " ".join(body)))
    docs = []
    for d in range(240):
        item = items[d % 30][1].split()
        kind = d // 30
        if kind == 1:
            item = [t.lower() for t in item]
        elif kind == 2:
            other = {}
            item = [other.setdefault(t, str(10 + len(other))) if t.isdigit() else t for t in item]
        elif kind == 3:
            item = [str(rng.randrange(20, 90)) if t.isdigit() else t for t in item]
        elif kind == 4:
            item = item[: len(item) // 2]
        elif kind == 5:
            item = item[: rng.randrange(6, len(item))]
        elif kind == 6:
            item = [t if k % 5 else rng.choice(words) for k, t in enumerate(item)]
        elif kind == 7:
            rng.shuffle(item)
        docs.append((d, " ".join([*rng.choices(words, k=40), *item, *rng.choices(words, k=30)])))
    hits = found(spark, docs, items)
    expected = {(d, i) for d, text in docs for i, item in items if straight(item, text)}
    assert len(expected) > 100
    assert expected <= set(hits), expected - set(hits)
    # what else is found drifts over a changed word, and holds half of the item all the same
    for d, i in set(hits) - expected:
        assert hits[d, i].windows >= hits[d, i].of * 0.5 or d // 30 in (3, 6), (d, i)
    assert all(d % 30 == i for d, i in hits)


def test_few_words_and_many_names(spark):
    poor = "Name Anna Lee Carl Otto Bonn 5 Mars 7 Jupiter"
    alice = "Alice has three red apples today"
    docs = [(1, f"x {poor} y"), (2, f"x {poor.lower()} y"), (3, f"Question: {alice}"), (4, f"the {alice.upper()}"), (5, poor.replace("Anna", "Dora"))]
    assert {(1, 1), (2, 1), (3, 2), (4, 2)} <= set(found(spark, docs, [(1, poor), (2, alice)]))


def test_spelled_numbers_capitals_and_long_units(spark):
    t = canonical("The IBM plant lies three kilometers off. IT SAYS SO here.")
    assert t.slots(0, len(t.hashes)) == ["name:ibm", "num:three", "unit:kilometers"]
    item = "A van of the IBM plant drives three kilometers north and then turns back after five more minutes of rest"
    moved = item.replace("IBM", "SAP").replace("three kilometers", "12 miles").replace("five", "nine")
    assert canonical("It lies one kilometer off.").slots(0, 5) == []
    # with "one" it is another token, and the rest a copy
    hits = found(spark, [(1, f"x {moved} y"), (2, f"x {item.upper()} y"), (3, "x " + item.replace("three", "one")), (4, "x " + item.replace("three", "one").replace("back", "off"))], [(1, item)])
    assert {(1, 1), (2, 1), (3, 1)} == set(hits) and not hits[1, 1].exact and hits[2, 1].exact


def test_short_items_inside_texts(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}{d}" for a in "bdfgklm" for b in "aeiou" for c in "nrst" for d in "ao"]
    items = [(n, " ".join(rng.sample(words, n))) for n in range(2, 17)]
    filler = [f"x{w}" for w in words]
    docs = [(n, f"{' '.join(rng.choices(filler, k=30))} {text.upper()} {' '.join(rng.choices(filler, k=30))}") for n, text in items]
    docs += [(100 + n, " ".join(text.split()[:-1][:7])) for n, text in items]
    assert set(found(spark, docs, items)) == {(n, n) for n, _ in items}


def test_short_questions_numbers_and_single_words(spark):
    sums = "2 + 2 = 4; 3 + 5 = 8; 12 + 30 = 42"
    items = [(1, "Who wrote Hamlet?"), (2, "What is 7?"), (3, sums), (4, "1 2 3"), (5, "Hamlet")]
    docs = [(1, "Quiz: Who wrote Hamlet? Answer now."), (2, "so what is 7? fine"), (3, f"Sums: {sums} and so on"), (4, "count 1 2 3 now"), (5, "what is 8?"), (6, "1, 2, 3"), (7, "Hamlet!"), (8, sums.replace("3 + 5", "4 + 4"))]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 2), (3, 3), (6, 4), (7, 5)}


def test_one_token_replaced(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    items, docs, filler = [], [], "other words stand here " * 10
    for n, size in enumerate(range(9, 25)):
        text = words[n * 12 : n * 12 + size]
        items.append((n, " ".join(text)))
        docs += [(1000 * n + g, f"{filler}{' '.join([*text[:g], 'new', *text[g + 1 :]])} {filler}") for g in range(size)]
        docs.append((1000 * n + 999, f"{filler}{' '.join([*text[:2], 'new', *text[3:6], 'new', *text[7:]][:9])} {filler}"))
    hits = found(spark, docs, items)
    for d, _ in docs:
        assert (d % 1000 != 999) == ((d, d // 1000) in hits), d
    number = "Tom has 3 apples and gives 3 away to Ann"
    swapped = [(1, number.replace("3", "5").replace("away", "out")), (2, number.replace("has 3", "has 6").replace("away", "out")), (3, f"he says {number.lower().replace('away', 'off')} so")]
    hits = found(spark, swapped, [(1, number)])
    assert set(hits) == {(1, 1), (3, 1)} and not hits[1, 1].exact and hits[3, 1].exact


def test_scripts_without_blanks(spark):
    item = "\u4e00\u5217\u706b\u8f66\u4ece\u5317\u4eac\u5f00\u5f80\u4e0a\u6d77\u8def\u4e0a\u8981\u8d70\u591a\u5c11\u4e2a\u5c0f\u65f6\u624d\u5230"
    before, after = "\u4eca\u5929\u6211\u4eec\u5b66\u4e60", "\u8bf7\u56de\u7b54"
    docs = [(1, before + item + after), (2, before + item[:6] + after), (3, before + item.replace("\u4e0a\u6d77", "\u5e7f\u5dde") + after), (4, before + after)]
    assert set(found(spark, docs, [(1, item)])) == {(1, 1), (3, 1)}
