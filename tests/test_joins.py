from arkivist import queries
from arkivist.operators import tree
from arkivist.testdata import part_trees

SMALL = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_trees_and_prune_plans_broadcast_nothing_that_grows(spark, monkeypatch):
    """However small the files below look: at 60 times sf0.1 a 300 MB side was taken for a small one."""
    plans, write = [], tree.written
    monkeypatch.setattr(tree, "written", lambda frame, name: plans.append(plan_of(frame)) or write(frame, name))
    for name in ("prune_file_level", "prune_apply_catalog", "survivor_check", "prune_group_states"):
        plans.append(plan_of(queries.queries()[name](spark, SMALL)))
    plans.append(plan_of(tree.dir_nodes(tree.file_nodes(part_trees(spark, SMALL)))))
    assert any("Join" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]
