"""Small tables and brute-force helpers for the operators' tests."""

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
A = "The quick brown fox jumps over the lazy dog and runs through the green field by the old river today."
B = "Une phrase tout autre, avec des mots choisis pour ne rien partager du tout avec la première des lignes."


def docs(spark, *texts, ids=None):
    """Documents from texts; ids count from 0 unless given."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOC)


def components(nodes, linked):
    """Least node reachable, by union-find over all pairs."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
