"""Queries that read Ruby sources made from the tables and resolve them, with SQL twins that compute the same from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import index
from ..operators.search import ancestors_of
from ..sources.facts import facts
from .catalogue import Code, duck

#: A file for each part, one for the modules, one for aliases.
_SOURCES = """
SELECT 'file:///w/lib/p' || p.k || '.rb' AS uri, 'module ' || p.brand || nl || '  class P' || p.k || CASE WHEN u.cls IS NOT NULL THEN ' < ' || u.cls ELSE '' END || nl
  || CASE WHEN s.k IS NOT NULL THEN '    include S' || s.k || nl ELSE '' END || CASE WHEN n.k IS NOT NULL THEN '    prepend W' || n.k || nl ELSE '' END
  || CASE WHEN p.size >= 40 THEN '    SIZE = ' || p.size || nl ELSE '' END || '    def m1(who, loud:)' || nl || '      @size = SIZE' || nl || '    end' || nl
  || '    private' || nl || '    def m2; end' || nl || CASE WHEN p.size <= 5 THEN '    def self.make; end' || nl ELSE '' END || '  end' || nl || 'end' || nl AS source
FROM p CROSS JOIN (SELECT chr(10) AS nl) c LEFT JOIN p u ON u.k = CAST(floor(p.k / 4) AS BIGINT) LEFT JOIN s ON s.k = p.k LEFT JOIN n ON n.k = p.k
UNION ALL SELECT 'file:///w/lib/s' || s.k || '.rb', 'module S' || s.k || chr(10) || CASE WHEN n.k IS NOT NULL THEN '  include K' || n.k || chr(10) ELSE '' END || '  def s1; end' || chr(10) || 'end' || chr(10) FROM s LEFT JOIN n ON n.k = s.k
UNION ALL SELECT 'file:///w/lib/w' || k || '.rb', 'module W' || k || '; end' || chr(10) || 'module K' || k || '; end' || chr(10) || 'Z' || k || ' = S1' || chr(10) FROM n
"""


def sources(t: Code) -> DataFrame:
    return t.sql("SELECT * FROM (" + _SOURCES + ") x")


def _resolved(spark, d) -> DataFrame:
    t = Code(spark, d)
    g = index(sources(t))
    defined = g.definitions.where("declaration IS NOT NULL").select(F.col("declaration").alias("name")).distinct()
    decls = g.declarations.join(defined, "name", "left_semi").select(F.lit("declaration").alias("item"), F.col("name").alias("a"), F.col("kind").alias("b"), F.col("owner").alias("c"))
    spaces = g.declarations.join(defined, "name", "left_semi").where("kind IN ('Class', 'Module')")
    chains = ancestors_of(g.ancestors, spaces.select("name")).select(F.lit("chain"), "name", "chain", F.lit("complete"))
    refs = g.constant_references.where("declaration IS NOT NULL").select(F.lit("reference"), "uri", "path", "declaration")
    seen = g.definitions.where("kind = 'Method'").select(F.lit("visibility"), "declaration", "visibility", F.array_join(F.transform("params", lambda x: x["name"]), ","))
    return decls.unionAll(chains).unionAll(refs).unionAll(seen)


def _facts(spark, d) -> DataFrame:
    return facts(sources(Code(spark, d))).groupBy("fact", "kind", "path").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


QUERIES = {"index_facts": _facts, "index_resolved": _resolved}

_OWN = "own AS (SELECT p.*, u.cls AS up, u.brand AS up_brand, s.k AS sk, n.k AS nk FROM p LEFT JOIN p u ON u.k = CAST(floor(p.k / 4) AS BIGINT) LEFT JOIN s ON s.k = p.k LEFT JOIN n ON n.k = p.k), atl AS (SELECT *, 3 + (sk IS NOT NULL)::INT + (nk IS NOT NULL)::INT AS l0 FROM own), ln AS (SELECT *, l0 + (size >= 40)::INT AS l1 FROM atl)"
_SIZE = "sz AS (SELECT up.cls, arg_min(up.acls, up.i) AS holder FROM up JOIN p a ON a.cls = up.acls AND a.size >= 40 GROUP BY up.cls)"
ORACLES = {
    "index_facts": duck(
        "SELECT fact, kind, path, count(*) AS n, sum(line)::BIGINT AS lines FROM f GROUP BY 1, 2, 3",
        _OWN,
        """f AS (SELECT 'definition' AS fact, 'Module' AS kind, brand AS path, 1 AS line FROM p UNION ALL SELECT 'definition', 'Class', 'P' || k, 2 FROM p UNION ALL SELECT 'constant', 'ref', up_brand, 2 FROM own WHERE up IS NOT NULL UNION ALL SELECT 'constant', 'ref', up, 2 FROM own WHERE up IS NOT NULL
        UNION ALL SELECT 'constant', 'ref', 'S' || sk, 3 FROM own WHERE sk IS NOT NULL UNION ALL SELECT 'constant', 'ref', 'W' || nk, 3 + (sk IS NOT NULL)::INT FROM own WHERE nk IS NOT NULL UNION ALL SELECT 'definition', 'Constant', 'SIZE', l0 FROM atl WHERE size >= 40
        UNION ALL SELECT 'definition', 'Method', 'm1()', l1 FROM ln UNION ALL SELECT 'definition', 'InstanceVariable', '@size', l1 + 1 FROM ln UNION ALL SELECT 'constant', 'ref', 'SIZE', l1 + 1 FROM ln UNION ALL SELECT 'definition', 'Method', 'm2()', l1 + 4 FROM ln UNION ALL SELECT 'definition', 'Method', 'make()', l1 + 5 FROM ln WHERE size <= 5
        UNION ALL SELECT 'definition', 'Module', name, 1 FROM s UNION ALL SELECT 'constant', 'ref', 'K' || n.k, 2 FROM s JOIN n ON n.k = s.k UNION ALL SELECT 'definition', 'Method', 's1()', 2 + (n.k IS NOT NULL)::INT FROM s LEFT JOIN n ON n.k = s.k
        UNION ALL SELECT 'definition', 'Module', 'W' || k, 1 FROM n UNION ALL SELECT 'definition', 'Module', 'K' || k, 2 FROM n UNION ALL SELECT 'definition', 'ConstantAlias', 'Z' || k, 3 FROM n UNION ALL SELECT 'constant', 'ref', 'S1', 3 FROM n)""",
    ),
    "index_resolved": duck(
        """SELECT 'declaration' AS item, brand AS a, 'Module' AS b, 'Object' AS c FROM br UNION ALL SELECT 'declaration', cls, 'Class', brand FROM p UNION ALL SELECT 'declaration', cls || '::SIZE', 'Constant', cls FROM p WHERE size >= 40
        UNION ALL SELECT 'declaration', cls || '#m1()', 'Method', cls FROM p UNION ALL SELECT 'declaration', cls || '#m2()', 'Method', cls FROM p UNION ALL SELECT 'declaration', cls || '#@size', 'InstanceVariable', cls FROM p UNION ALL SELECT 'declaration', cls || '::<P' || k || '>#make()', 'Method', cls || '::<P' || k || '>' FROM p WHERE size <= 5
        UNION ALL SELECT 'declaration', name, 'Module', 'Object' FROM s UNION ALL SELECT 'declaration', name || '#s1()', 'Method', name FROM s UNION ALL SELECT 'declaration', x || k, 'Module', 'Object' FROM n CROSS JOIN (VALUES ('W'), ('K')) t(x) UNION ALL SELECT 'declaration', 'Z' || k, 'ConstantAlias', 'Object' FROM n
        UNION ALL SELECT 'chain', name, string_agg(ancestor, ' ' ORDER BY pos), 'complete' FROM anc WHERE name NOT IN ('Object', 'Kernel', 'BasicObject') GROUP BY name
        UNION ALL SELECT 'visibility', cls || '#m1()', 'public', 'who,loud' FROM p UNION ALL SELECT 'visibility', cls || '#m2()', 'private', '' FROM p UNION ALL SELECT 'visibility', cls || '::<P' || k || '>#make()', 'public', '' FROM p WHERE size <= 5 UNION ALL SELECT 'visibility', name || '#s1()', 'public', '' FROM s
        UNION ALL SELECT 'reference', 'file:///w/lib/p' || k || '.rb', x, x FROM own CROSS JOIN LATERAL (SELECT unnest([up_brand, up, 'S' || sk, 'W' || nk]) AS x) WHERE x IS NOT NULL
        UNION ALL SELECT 'reference', 'file:///w/lib/p' || k || '.rb', 'SIZE', holder || '::SIZE' FROM p JOIN sz ON sz.cls = p.cls UNION ALL SELECT 'reference', 'file:///w/lib/s' || s.k || '.rb', 'K' || n.k, 'K' || n.k FROM s JOIN n ON n.k = s.k UNION ALL SELECT 'reference', 'file:///w/lib/w' || k || '.rb', 'S1', 'S1' FROM n""",
        _OWN, _SIZE,
    ),
}
