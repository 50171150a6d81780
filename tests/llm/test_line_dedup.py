from collections import Counter, defaultdict

from tmaps.llm import line_dedup as X

SCHEMA = "doc_id long, source string, text string, host string, n long, lines string, page int"


def brute(rows, ratio=X.RATIO, least=X.LEAST_PAGES):
    pages, seen = Counter(s for _, s, _ in rows), defaultdict(Counter)
    for _, s, t in rows:
        seen[s].update({x.strip(" ") for x in (t or "").split("\n")} - {""})
    out = []
    for d, s, t in rows:
        lines = (t or "").split("\n") if t else []
        kept = [x for x in lines if not x.strip(" ") or seen[s][x.strip(" ")] < least or seen[s][x.strip(" ")] <= ratio * pages[s]]
        out.append((d, s, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, rows_of):
    rows = [(i, "a", f"menu\nline {i}\n\n menu \nfoot {i % 3}") for i in range(12)] + [(20 + i, "b", f"menu\nown {i}") for i in range(2)]
    rows += [(30 + i, None, "x\ny" if i % 2 else None) for i in range(9)] + [(40, "c", ""), (41, "c", "\n\n"), (None, "c", "z"), (0, "a", rows[0][2])]
    rows += [(50 + i, "hot", "same\n" + "word " * 3000 + str(i)) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], SCHEMA)
    assert rows_of(X.drop_boilerplate(df, "doc_id", "source", "text")) == brute(rows)


def test_empty_table(spark):
    assert X.drop_boilerplate(spark.createDataFrame([], SCHEMA), "doc_id", "source", "text").count() == 0
