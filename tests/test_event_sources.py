"""Every interaction behind a synthesized event is kept, through all merges."""

from collections import Counter

from plansight.operators import synthesis as Y


def test_sources_survive_every_merge(spark):
    rows = [("r", "click_handler", "handleCreateTeam", "a.tsx", 3), ("r", "mutation", "team.create", "b.ts", 9),
            ("r", "click_handler", "handleAddTeam", "c.tsx", 2), ("r", "click_handler", "handleUpdateTeam", "a.tsx", 12),
            ("r", "click_handler", "handleToggleTeam", "a.tsx", 15), ("q", "click_handler", "handleCreateTeam", "a.tsx", 3)]
    inter = spark.createDataFrame(
        [(*r, "", 0.85, "onClick", ["team"], None, 0, i) for i, r in enumerate(rows)],
        "repo string, type string, function_name string, path string, line_no int, context string, confidence double, "
        "trigger string, entities array<string>, ui_hint string, first_detector int, first_match_no int")
    events, links = Y.synthesize_with_sources(inter)
    named = {(e.repo, e.pos): (e.name, e.n_sources) for e in events.collect()}
    links = links.collect()
    assert sorted((x.repo, x.source_path, x.source_function) for x in links) == sorted((r[0], r[3], r[2]) for r in rows)
    assert Counter((x.repo, *named[x.repo, x.pos]) for x in links) == {(repo, *e): e[1] for (repo, _), e in named.items()}
    got = {}
    for x in links:
        got.setdefault((x.repo, named[x.repo, x.pos][0]), set()).add(x.source_function)
    assert got == {("r", "team_created"): {"handleCreateTeam", "team.create", "handleAddTeam"},
                   ("r", "team_edited"): {"handleUpdateTeam", "handleToggleTeam"}, ("q", "team_created"): {"handleCreateTeam"}}
