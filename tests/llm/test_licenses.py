import math
import random
import re

from peakforge.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, threshold=0.8):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places = WORD.findall(low), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    wanted = [(label, set(t.split())) for label, ts in licenses.TEMPLATES.items() for t in ts]
    least = [math.ceil(threshold * len(t)) for _, t in wanted]
    must = [{w for other, u in wanted if other != label and len(t & u) >= n for w in t - u} for (label, t), n in zip(wanted, least, strict=True)]
    found, share, lines, every = set(), 0.0, low.split("\n"), set()
    for first in range(len(lines)):
        for n in range(1, min(licenses.LINES, len(lines) - first) + 1):
            block = set(WORD.findall("\n".join(lines[first : first + n])))
            every |= {label for (label, t), k in zip(wanted, least, strict=True) if len(block & t) >= k}
            hits = [(label, block & t, len(block & t) / len(t)) for (label, t), k, m in zip(wanted, least, must, strict=True) if len(block & t) >= k and m <= block]
            for label, held, part in hits:
                if not any(held <= h and (len(h) > len(held) or (len(h) == len(held) and p > part)) for _, h, p in hits):
                    found.add(label)
                    share = max(share, part)
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places}), sorted(found), 1.0 if places else share, sorted(every))


def test_scan_equals_brute_force(spark):
    rng = random.Random(0)
    pieces = ["Under the MIT License", "under the mit license under the mit license", "Apache License, Version 2.0", "CC-BY-NC", "cc by\nnc", "lorem", "the", "été", "licensed under", "version 3",
              "GNU General Public License", "Public License, version 3 licensed under the gnu general", "mit-license", "\n", "4.0", "Redistribution and use in source and binary forms, without modification, are permitted"]
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", " \n", "under the MIT License" * 2000, "word " * 30000 + "cc by nc", licenses.TEMPLATES["gpl-3"][0].upper()]
    rows = [(i if i % 7 else None, t, "x", 0.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, labels string, score double")
    got = [(r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], list(r["base"]), list(r["found"]), r["score"], list(r["matched"]))) for r in licenses.scan(docs).collect()]
    want = [(d, brute(t)) for d, t, *_ in rows + rows[:5]]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert licenses.scan(docs.limit(0)).count() == 0


def test_versions_are_told_apart(spark):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.",
        "x\nThis work is licensed under the GNU General Public License, version 2.\ny",
        "licensed under the GNU Lesser General Public License version 3",
        "licensed under the GNU Affero General\nPublic License, version 3",
        "licensed under the GNU General Public License",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "Permission is\nhereby granted,\nfree of charge, to any\nperson obtaining a\ncopy of\nthis software",
        "Permission is hereby granted, free of\ncharge, to any person obtaining a copy\nof this software",
        "Creative Commons Attribution 4.0 International License",
        "Creative Commons Attribution-ShareAlike 4.0 International License",
        "licensed under the GNU General Public License version 3\nlicensed under the GNU Lesser General Public License version 3",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["found"]) for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(texts))] == [["gpl-3"], ["gpl-2"], ["lgpl-3"], ["agpl-3"], [], ["bsd"], ["mit"], ["mit"], ["cc-by"], ["cc-by-sa"], ["gpl-3", "lgpl-3"]]


def test_one_stage_without_a_shuffle_of_blocks(spark, capsys):
    docs = spark.createDataFrame([(1, "licensed under the gnu general public license version 3")], "doc_id long, text string")
    licenses.scan(docs).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(tid" not in plan and "BroadcastHashJoin [rank" in plan and "BuildRight" in plan.split("BroadcastHashJoin [rank")[1].split("\n")[0]  # the templates are what is sent
