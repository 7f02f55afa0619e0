"""Queries over the parent links of ``chunks``."""

from __future__ import annotations

from loomspark.operators import hierarchy as H
from loomspark.sources.tables import table


def p2_found(spark, sf):
    """Chunks on a cycle of parent links, or with a chain of parents into one."""
    return H.cyclic_nodes(table(spark, sf, "chunks"))


def p2_hierarchy(spark, sf):
    """Path, depth, root and number of descendants of every chunk in a tree."""
    return H.hierarchy(table(spark, sf, "chunks"), path_ids=False)


def p2_descendants(spark, sf):
    """Every descendant of every chunk, with its distance."""
    return H.descendant_lists(table(spark, sf, "chunks"))


QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants}

_LINKS = """
n AS (SELECT id, min(parent_id) AS pid, max(qualified_name) AS name FROM chunks WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT n.id, n.pid FROM n JOIN n AS m ON n.pid = m.id)"""

_TREE = f"""{_LINKS},
t AS (
  SELECT id, id AS root, 0 AS depth, coalesce(name, '') AS path FROM n WHERE id NOT IN (SELECT id FROM e)
  UNION ALL
  SELECT n.id, t.root, t.depth + 1, t.path || '/' || coalesce(n.name, '') FROM t JOIN n ON n.pid = t.id
),
d AS (
  SELECT e.pid AS id, e.id AS descendant_id, 1 AS distance FROM e JOIN t ON t.id = e.id
  UNION ALL
  SELECT e.pid, d.descendant_id, d.distance + 1 FROM d JOIN e ON e.id = d.id
)"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_LINKS},
r(id, anc) AS (SELECT id, pid FROM e UNION SELECT r.id, e.pid FROM r JOIN e ON r.anc = e.id)
SELECT min(r.anc) AS cycle_id, r.id FROM r WHERE r.anc IN (SELECT id FROM r WHERE id = anc) GROUP BY r.id""",
    "p2_hierarchy": f"""WITH RECURSIVE {_TREE}
SELECT t.id, t.root, t.depth, t.path, coalesce(c.k, 0) AS n_descendants
FROM t LEFT JOIN (SELECT id, count(*) AS k FROM d GROUP BY id) AS c ON c.id = t.id""",
    "p2_descendants": f"WITH RECURSIVE {_TREE} SELECT id, descendant_id, distance FROM d",
}
