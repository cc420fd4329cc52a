"""Small tables with the awkward rows every operator must take."""

import re

LONG = "lorem ipsum dolor sit amet " * 8000 + "x" * 5000
EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again"),
    (2, None), (3, ""), (4, " \t\n"), (None, "a text without an id"),
    (5, "said twice in one row"), (5, "said twice in one row"),
    (6, LONG), (7, "the quick  brown fox jumps over\nthe lazy dog again and again"),
    (8, "Žluťoučký kůň 日本語   naïve café ß"), (9, "x"),
]
# Names the operators use themselves, as extra columns of the input.
CLASHES = ("kept", "print", "hash", "word", "key", "value", "row", "n", "node", "_id", "norm", "host", "path", "dotted.name")


def table(spark, rows, text="text", extra=CLASHES):
    schema = f"doc_id long, {text} string, source string, lang string" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(i, t, None if i == 2 else "s", "en", *("z" * len(extra))) for i, t in rows], schema)


def edge(spark):
    return table(spark, EDGE_ROWS)


def empty(spark):
    return table(spark, [])


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def plain_shingles(text, size=5):
    words = plain_words(text)
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(nodes, pairs):
    """Smallest reachable node of each node, by repeated relabelling."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(root[a], root[b])
            for node in (a, b):
                if root[node] != least:
                    root[node], changed = least, True
    return root
