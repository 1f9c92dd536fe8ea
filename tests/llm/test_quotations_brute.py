"""Quotation linking of generated conversations against plain Python."""

import random

from pyspark.sql import functions as F

from civicflow.llm import quotations

SENTENCES = [f"sentence number {i} of the talk" for i in range(14)] + ["I agree", "no", "thanks  a lot"]


def conversations(seed, n_conv=25):
    """Messages that quote earlier ones of their own or another conversation, whole or in part, nested."""
    rng = random.Random(seed)
    rows, bodies = [], {}
    for c in range(n_conv):
        for t in range(rng.randrange(1, 9)):
            parts = []
            for _ in range(rng.randrange(3)):
                conv = c if rng.random() < 0.8 else rng.randrange(n_conv)
                known = [k for k in bodies if k[0] == conv]
                if known and rng.random() < 0.85:
                    lines = bodies[rng.choice(known)].split("\n")
                    if rng.random() < 0.4:
                        lines = lines[:rng.randrange(1, len(lines) + 1)]
                else:
                    lines = ["words that nobody said"]
                marks = rng.choice([">", "> ", ">> ", "> > ", " > "])
                parts.append("\n".join(marks + (x.upper() if rng.random() < 0.3 else x) for x in lines))
            own = "\n".join(rng.choice(SENTENCES + [""]) for _ in range(rng.randrange(1, 5)))
            parts.insert(rng.randrange(len(parts) + 1), own)
            text = "\n".join(parts)
            bodies[c, t] = text
            rows.append((c, t, rng.choice(["user", "assistant"]), text))
    return rows


def norm(text):
    return " ".join("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text).split())


def level_of(line):
    """(number of quote marks, the rest): up to three blanks before each mark, one blank after the last."""
    at, level = 0, 0
    while True:
        k = at
        while k < len(line) and line[k] in " \t" and k - at < 3:
            k += 1
        if k < len(line) and line[k] == ">":
            level, at = level + 1, k + 1
        else:
            return level, (line[at + 1:] if level and line[at:at + 1] in (" ", "\t") else line[at:])


def parse(text):
    own, passages, before = [], [], 0
    for line in text.split("\n"):
        level, rest = level_of(line)
        if level == 0:
            own.append(line)
        elif level == before:
            passages[-1][1].append(rest)
        else:
            passages.append((level, [rest]))
        before = level
    return ("\n".join(own).strip("\r\n") if passages else text), passages


def brute(rows):
    """(conv, turn) -> (parent, root, depth, n_passages, n_linked, source, clean), by looking through all messages."""
    clean, quoted, units = {}, {}, {}
    for c, t, _, text in rows:
        own, passages = parse(text)
        clean[c, t], quoted[c, t] = own, passages
        paragraphs, now = [], []
        for line in own.split("\n") + [""]:
            if line.strip(" \t\r") == "":
                paragraphs.append("\n".join(now))
                now = []
            else:
                now.append(line)
        units[c, t] = {norm(x) for x in [own, *paragraphs, *own.split("\n")]} - {""}
    out = {}
    for c, t, _, _ in rows:
        linked = []
        for nth, (level, lines) in enumerate(quoted[c, t]):
            parts = ["\n".join(lines), *(lines if len(lines) > 1 else [])]
            found = []
            for k, part in enumerate(norm(p) for p in parts):
                here = sorted(x for cc, x in units if cc == c and x < t and part and part in units[cc, x]
                              and x == min(y for dd, y in units if dd == c and part in units[dd, y]))
                away = sorted((cc, x) for cc, x in units if cc != c and part and part in units[cc, x])
                if here:
                    found.append((False, k, (c, here[0])))
                elif away:
                    found.append((True, k, away[0]))
            if found:
                linked.append((level, nth, sum(len(x.split()) for x in lines), min(found)[2], min(found)[0]))
        own = [(level, -words, nth, s[1]) for level, nth, words, s, away in linked if not away]
        out[c, t] = [min(own)[3] if own else None, None, 0, len(quoted[c, t]), len(linked),
                     min((level, nth, s) for level, nth, _, s, _ in linked)[2] if linked else (None, None), clean[c, t]]
    for (c, t), r in out.items():
        at, depth = t, 0
        while out[c, at][0] is not None:
            at, depth = out[c, at][0], depth + 1
        r[1], r[2] = at, depth
    return out


def test_generated_conversations_match_brute_force(spark):
    links = 0
    for seed in (1, 2):
        rows = conversations(seed)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = quotations.reply_ordered(df.withColumns({x: F.lit(1) for x in ("hash", "clean", "units", "position", "level", "first")})).collect()
        want = brute(rows)
        assert len(got) == len(rows)
        for r in got:
            mine = [r["parent_turn"], r["root_turn"], r["depth"], r["n_passages"], r["n_linked"], (r["source_conv"], r["source_turn"]), r["clean"]]
            assert mine == want[r["conv_id"], r["turn"]], (r, want[r["conv_id"], r["turn"]])
            links += r["n_linked"]
        for c in {r["conv_id"] for r in got}:
            ours = sorted((r["position"], r["turn"]) for r in got if r["conv_id"] == c)
            order = sorted((want[c, t][1], want[c, t][2], t) for _, t in ours)
            assert [p for p, _ in ours] == list(range(len(ours))) and [t for _, t in ours] == [t for *_, t in order]
    assert links > 100


def test_long_repeated_and_tied_messages(spark):
    long = "\n".join(f"line {i} of a very long message" for i in range(20_000))
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "user", "\n".join("> " + x for x in long.split("\n")) + "\nread it"),
            (1, 2, "user", "> line 7 of a very long message\n> line 9 of a very long message\nthese"),
            (2, 0, "user", "same words"), (3, 0, "user", "same words"), (4, 0, "user", "> same words\nfrom where"), (4, 0, "user", "> same words\nfrom where")]
    got = quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 1]["parent_turn"] == 0 and by[1, 1]["clean"] == "read it" and by[1, 2]["parent_turn"] == 0 and by[1, 2]["n_passages"] == 1
    assert [(r["source_conv"], r["source_turn"]) for r in got if r["conv_id"] == 4] == [(2, 0)] * 2  # the smaller conversation
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2, 3]
