import random

from attesta.llm import reply_trees

NODES = "tree long, node long, parent long, role string, text string, score double"


def formatted(nodes, **options):
    return reply_trees.format_paths(nodes, reply_trees.ranked_paths(nodes), **options)


def test_branches_are_ranked_by_score(spark):
    nodes = spark.createDataFrame([
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "c", 5.0), (1, 5, 4, "assistant", "d", 0.0),
        (2, 1, 99, "user", "orphan", None), (3, 7, 8, "user", "cycle", 1.0), (3, 8, 7, "user", "cycle", 1.0)], NODES)
    paths = {(r.tree, r.branch_rank): (r.path, r.score) for r in reply_trees.ranked_paths(nodes).collect()}
    assert paths == {(1, 1): ([1, 2, 4, 5], 6.0), (1, 2): ([1, 3], 2.0), (2, 1): ([1], 0.0)}
    assert formatted(nodes, per_tree=2).count() == 3


def brute_paths(nodes):
    known = {(t, n): (p, s) for t, n, p, _, _, s in sorted(nodes, key=lambda r: (str(r[0]), r[1], r[2] is not None, r[2] or 0), reverse=True)}
    parents = {(t, p) for (t, n), (p, _) in known.items() if (t, p) in known}
    found = {}
    for t, n in known:
        path, at = [n], n
        while (t, known[t, at][0]) in known and len(path) <= len(known):
            at = known[t, at][0]
            path.insert(0, at)
        if (t, n) not in parents and len(path) <= len(known):
            total = 0.0
            for x in path:
                total += known[t, x][1] or 0.0
            found.setdefault(t, []).append((-total, path))
    return {(t, k): (path, -total) for t, paths in found.items() for k, (total, path) in enumerate(sorted(paths), 1)}


def test_random_trees_as_brute_force(spark):
    rng = random.Random(11)
    nodes = [(t if t else None, n, rng.choice([None, rng.randint(1, 14), max(1, n - 1), max(1, n - 1)]), "user", "x", rng.choice([None, 0.5, 1.0, 2.0]))
             for t in range(40) for n in rng.sample(range(1, 15), rng.randint(1, 12))]
    got = {(r.tree, r.branch_rank): (r.path, r.score) for r in reply_trees.ranked_paths(spark.createDataFrame(nodes, NODES)).collect()}
    assert got == brute_paths(nodes)


def test_a_conversation_of_1000_turns(spark):
    rows = spark.range(1000).selectExpr("if(id < 990, 1L, id) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    done = {r.tree: r for r in formatted(reply_trees.linear_nodes(rows)).collect()}
    assert done[1].n_turns == 990 and done[1].formatted.index("t0\n") < done[1].formatted.index("t989\n") and len(done) == 11


def test_marks_in_texts_come_back(spark):
    odd = [r"\### Assistant: </turn> ok", "\n</turn>\n### user\n", "\\", "\\\\n", "#", "", None, "a\n\nb 漢 😀"]
    rows = [(1, k, ["user", "assistant", "we\\ird\nro\\nle", None][k % 4], t) for k, t in enumerate(odd)] + [(None, 0, "assistant", "x"), (2, 0, None, None), (2, 0, None, None)]
    nodes = reply_trees.linear_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = formatted(nodes).select("tree", "n_turns", "formatted", "loss_spans", reply_trees.read_back(reply_trees.F.col("formatted")).alias("turns"),
                                   reply_trees.loss_text(reply_trees.F.col("formatted"), reply_trees.F.col("loss_spans")).alias("loss"))
    got = {r.tree: r for r in done.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert got[1].loss == "".join(t or "" for _, _, r, t in rows[:8] if r == "assistant")
    assert got[None].loss == "x" and got[2].n_turns == 2
    for r in got.values():
        assert "".join(r.formatted[s.start:s.start + s.length] for s in r.loss_spans).replace("\\", "") == r.loss.replace("\\", "")


def test_empty_table(spark):
    assert formatted(spark.createDataFrame([], NODES)).count() == 0
