from slidemill.llm import licenses as L

HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def names(text):
    return [x[0] for x in L.match(L.sentences(text))]


def test_each_sentence_is_known():
    for name, s in L.SENTENCES.items():
        found = L.sentences(f"Some words. {s}\nMore words.")
        assert [f[0] for f in found] == [name], name
    assert {n for *_, rule in L.RULES for n in rule} <= set(L.SENTENCES)


def test_rules():
    assert names("Text.\nReleased under the MIT License.\nText") == ["MIT"]
    assert names("a table | b |\nreleased under the  mit license") == ["MIT"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names("Licensed under CC BY-NC 4.0. And licensed under the Apache License, Version 2.0.") == ["CC-BY-NC-4.0"]
    assert names("Licensed under CC BY 4.0. Licensed under the Apache License, Version 2.0.") == ["CC-BY-4.0", "Apache-2.0"]
    assert names(HEADER) == ["Apache-2.0"]
    (_, kind, start, end), = L.match(L.sentences("x y.\n" + HEADER))
    assert kind == "permissive" and start == 5 and end > len(HEADER) - 10
    assert names("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:") == []
    assert names("This is about a license. The MIT license is short.") == []


def test_order_matters():
    a, b = L.SENTENCES["gpl-free"], L.SENTENCES["gpl3-terms"]
    assert names(f"{a} {b}") == ["GPL-3.0"] and names(f"{b}\n{a}") == []
    assert names(f"{a} one. two. {b}") == ["GPL-3.0"] and names(f"{a} one. two. three. four. {b}") == []


def test_table(docs_of, odd_rows):
    rows = [*odd_rows, (50, HEADER + "All rights reserved."), (51, "x. " * 20000 + L.SENTENCES["mit-released"])]
    out = L.scan(docs_of(rows)).collect()
    got = {r.doc_id: r.licenses for r in out}
    assert len(out) == len(rows) and got[50] == "Apache-2.0,proprietary" and got[51] == "MIT"
    assert all(r.licenses == "" and r.n_sentences == 0 for r in out if r.doc_id not in (50, 51))
    assert L.scan(docs_of(rows).where("doc_id < 0")).collect() == []


def brute(text):
    """Identifiers by trying every stretch of fragments at every place."""
    import re

    cuts = [0, *(m.end() for m in re.finditer(r"[.!?;:]+(?=\s|$)|\n", text)), len(text)]
    known = {L.normalise(x): n for n, x in L.SENTENCES.items()}
    out, k = [], 0
    while k < len(cuts) - 1:
        best = max((j for j in range(k + 1, len(cuts)) if L.normalise(text[cuts[k] : cuts[j]]) in known and L.normalise(text[cuts[k] : cuts[k + 1]])), default=None)
        if best:
            out.append(known[L.normalise(text[cuts[k] : cuts[best]])])
        k = best or k + 1
    return out


def test_sentences_against_brute_force():
    import random

    rng = random.Random(5)
    every = list(L.SENTENCES.values())
    for _ in range(60):
        parts = [rng.choice(every) if rng.random() < 0.6 else " ".join(rng.choice(["the", "software", "this", "is", "free"]) for _ in range(5)) + rng.choice(".;\n") for _ in range(rng.randrange(12))]
        text = rng.choice(["\n", "\n\n"]).join(p.replace(" ", rng.choice([" ", "  "])) for p in parts)
        got = [x[0] for x in L.sentences(text)]
        # A longer sentence may run into what follows it; what is found by stretches ends the same.
        assert got == [n for n in brute(text)]


def test_rules_against_brute_force():
    import random
    from itertools import combinations

    rng = random.Random(7)
    names_ = sorted({n for *_, r in L.RULES for n in r})
    for _ in range(200):
        rule = rng.choice(L.RULES)[2]
        found, number = [], 0
        for n in rng.choices(names_, k=2) + list(rule) + rng.choices(names_, k=3):
            number += rng.choice([1, 1, 2, 4])
            found.append((n, number, number * 10, number * 10 + 5))
        hits = []
        for licence, kind, r in L.RULES:
            for at in combinations(range(len(found)), len(r)):
                if [found[a][0] for a in at] == list(r) and all(found[y][1] - found[x][1] <= L.GAP + 1 for x, y in zip(at, at[1:], strict=False)):
                    first = all(not any(found[k][0] == r[s] and found[k][1] - found[at[s - 1]][1] <= L.GAP + 1 for k in range(at[s - 1] + 1, at[s])) for s in range(1, len(r)))
                    if first:
                        hits.append((-(at[-1] - at[0]), -len(r), at[0], at[-1], licence, kind))
        taken, want = set(), []
        for *_, i, j, licence, kind in sorted(set(hits)):
            if not taken & {*range(i, j + 1)}:
                taken |= {*range(i, j + 1)}
                want.append((licence, kind, found[i][2], found[j][3]))
        assert L.match(found) == sorted(want, key=lambda x: x[2])


def test_full_texts_and_lists():
    bsd = f"""{L.SENTENCES["bsd-use"]}

1. {L.SENTENCES["bsd-source"]}

2. {L.SENTENCES["bsd-binary"]}

3. {L.SENTENCES["bsd-name"]}

{L.SENTENCES["bsd-as-is"]} {L.SENTENCES["bsd-liable"]}"""
    assert names(bsd) == ["BSD-3-Clause"]
    assert names(bsd.replace("1.", "(a)").replace("2.", "*").replace("3. " + L.SENTENCES["bsd-name"], "")) == ["BSD-2-Clause"]
    mit = "\n".join(L.SENTENCES[n] for n in ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")).replace(", ", ",\n")
    assert names("Copyright (c) 2020 A. Person\n\n" + mit) == ["MIT"]
    gpl2 = L.SENTENCES["gpl2-terms"].replace("; ", ";\n") + "\n" + L.SENTENCES["gpl-hope"] + "\n" + L.SENTENCES["gpl-details"]
    assert names(gpl2) == ["GPL-2.0"]
    gpl3 = " ".join(L.SENTENCES[n] for n in ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-details", "gpl-received"))
    assert names(gpl3) == ["GPL-3.0"] and names(gpl3.replace("GNU General", "GNU Affero General").split(" You should")[0]) == ["AGPL-3.0"]


def test_repeated_sentences_take_linear_time():
    import time

    took = []
    for n in (4000, 32000):
        began = time.perf_counter()
        assert len(L.match(L.sentences((L.SENTENCES["mit-grant"] + "\n") * n))) == 0
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0] + 0.5
