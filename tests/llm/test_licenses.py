import random
import re

from hitlake.llm import licenses


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_matches_brute_force(docs):
    random.seed(7)
    parts = ["Under the MIT License", "under, the mit-license!", "apache", "license", "version", "2", "Version 2.0", "CC BY-NC", "cc", "by", "nc", "mit", "the", "under", "é", "漢字", "x1", "\n", "Apache License, Version 2.0"]
    rows = [(k, " ".join(random.choices(parts, k=random.randint(0, 60)))) for k in range(300)]
    got = {r.doc_id: base(r) for r in licenses.scan(docs(rows)).collect()}
    assert got == {k: brute(t) for k, t in rows}
    assert sum(v[1] for v in got.values()) > 100


def plain(words):
    """Labels and score by trying every place: key phrases at their places or off by DRIFT words, and a plain common subsequence."""
    stands = lambda part: [i for i in range(len(words)) if words[i : i + len(part)] == part]
    labels, score = set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        if stands(phrase.split()):
            labels.add(label)
            score = 1.0
    for label, text, keys in licenses.GRANTS:
        own, keys = text.split(), [k.split() for k in keys]
        at = [next(i for i in range(len(own)) if own[i : i + len(k)] == k) for k in keys]
        for first in stands(keys[0]):
            start = first - at[0]
            if all(any(abs(i - start - a) <= licenses.DRIFT for i in stands(k)) for a, k in zip(at, keys)):
                region = words[max(0, start - licenses.DRIFT) : start + len(own) + licenses.DRIFT]
                row = [0] * (len(own) + 1)
                for w in region:
                    row = [0] + [max(row[j + 1], 0) if w != own[j] else row[j] + 1 for j in range(len(own))]
                    for j in range(len(own)):
                        row[j + 1] = max(row[j + 1], row[j])
                if row[-1] / len(own) >= licenses.ENOUGH:
                    labels.add(label)
                    score = max(score, row[-1] / len(own))
    return ",".join(sorted(labels)), score


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including"


def test_grants_and_their_edited_copies(docs):
    rows = [
        (1, "word " * 50 + MIT), (2, MIT.replace("person", "human").replace("associated ", "")), (3, MIT.replace("person", "human being who is")), (4, MIT.replace("without restriction", "with care")),
        (5, "Permission is hereby granted to nobody"), (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (7, "free software for any person"), (8, "word " * 30 + MIT.replace("any person", "any one person or two") + " " + MIT), (9, "permission is hereby granted free of charge " + "word " * 40 + "deal in the software without restriction"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs(rows)).collect()}
    n = len(licenses.GRANTS[0][1].split())
    assert got[1] == ("mit", 1.0) and got[2] == ("mit", (n - 2) / n) and got[3] == ("mit", (n - 1) / n) and got[6] == ("bsd", 1.0) and got[8] == ("mit", 1.0)
    assert all(got[k] == ("", 0.0) for k in (4, 5, 7, 9))


def test_labels_match_brute_force(docs):
    random.seed(11)
    grants = [g[1].split() for g in licenses.GRANTS]
    rows = []
    for k in range(250):
        text = []
        for _ in range(random.randint(0, 4)):
            own = list(random.choice(grants))
            for _ in range(random.choice([0, 0, 1, 2, 6])):
                at = random.randrange(len(own))
                own[at : at + 1] = random.choice([[], ["other"], [own[at], "more"], random.choices(["software", "license", "the"], k=3)])
            text += random.choices(["word", "license", "software", "the"], k=random.randint(0, 6)) + own
        rows.append((k, " ".join(text)))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs(rows)).collect()}
    assert got == {k: plain(t.split()) for k, t in rows}
    assert len({v[0] for v in got.values()}) > 20


def test_base_labels_stay(docs):
    r = licenses.scan(docs([(1, "CC BY NC, under the MIT License; Apache License version 2")])).first()
    assert (r.base_labels, r.labels, r.n_base, r.score) == ("apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,mit", 3, 1.0)


def test_edges(edge, empty):
    got = licenses.scan(edge).collect()
    assert len(got) == 10
    assert sorted(map(str, map(base, got))) == sorted(str(brute(r.text)) for r in edge.collect())
    assert licenses.scan(empty).count() == 0
