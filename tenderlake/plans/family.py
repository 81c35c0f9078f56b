"""Families of markets (buyer, category prefix) as one relation of windows over one exchange.

Markets of a family are dealt once by (buyer, level, prefix); chain, waves, coherence and the
last market are windows and aggregates of that partitioning.  Level 8 is the category itself,
lower levels are its prefixes, for which no duration is inferred.

Where a buyer has very many markets, its time line is cut into segments of days instead: each is
scanned by itself, one row a segment carries positions and waves over its border, and rows take
what their segment adds.  A support list then holds the newest markets only (``SUPPORT``).
"""

from __future__ import annotations

FAMILY = "siret_acheteur, niveau, famille"
#: Confidence levels and the score of coverage that each stands for.
SCORES = {"élevée": 1.0, "moyenne": 0.66, "faible": 0.33, "aucune": 0.0}


#: Markets that the support list of a family of a large buyer holds.
SUPPORT = 30

_CHAIN = f"""dated AS (
  SELECT *, CASE WHEN duree <> 0 THEN add_months(date_notification, CAST(bround(duree, 0) AS INT)) END AS fin,
         lag(date_notification) OVER (PARTITION BY {FAMILY} ORDER BY date_notification, uid) AS avant,
         row_number() OVER (PARTITION BY {FAMILY} ORDER BY date_notification, uid) AS position FROM levelled),
chained AS (
  SELECT * EXCEPT (avant), sum(CASE WHEN avant IS NULL OR datediff(date_notification, avant) > 30 THEN 1 ELSE 0 END)
            OVER (PARTITION BY {FAMILY} ORDER BY date_notification, uid ROWS UNBOUNDED PRECEDING) AS vague FROM dated),
"""

#: The newest markets of each family, without a list of all.
_NEWEST = f"""recents AS (
  SELECT {FAMILY}, transform(array_sort(collect_list(struct(rang, uid))), x -> x.uid) AS marches_support FROM (
    SELECT *, row_number() OVER (PARTITION BY {FAMILY} ORDER BY date_notification DESC, siren, uid) AS rang FROM chained) WHERE rang <= {SUPPORT}
  GROUP BY {FAMILY}),
"""


def _segmented(span: int) -> str:
    """The chain by segments: ``bornes`` has a row a segment, ``suite`` what comes before it."""
    cut, order = f"PARTITION BY {FAMILY}, segment", "ORDER BY date_notification, uid"
    before = f"OVER (PARTITION BY {FAMILY} ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""dated AS (
  SELECT *, CASE WHEN duree <> 0 THEN add_months(date_notification, CAST(bround(duree, 0) AS INT)) END AS fin,
         lag(date_notification) OVER ({cut} {order}) AS avant, row_number() OVER ({cut} {order}) AS position
  FROM (SELECT *, floor(unix_date(date_notification) / {span}) AS segment FROM levelled)),
scanned AS (
  SELECT *, sum(CASE WHEN avant IS NULL OR datediff(date_notification, avant) > 30 THEN 1 ELSE 0 END) OVER ({cut} {order} ROWS UNBOUNDED PRECEDING) AS vague FROM dated),
bornes AS (
  SELECT {FAMILY}, segment, min(date_notification) AS debut, max(date_notification) AS fin, count(*) AS nb, max(vague) AS vagues FROM scanned GROUP BY {FAMILY}, segment),
jointes AS (
  SELECT *, CASE WHEN datediff(debut, lag(fin) OVER (PARTITION BY {FAMILY} ORDER BY segment)) <= 30 THEN 1 ELSE 0 END AS suit FROM bornes),
suite AS (
  SELECT {FAMILY}, segment, coalesce(sum(nb) {before}, 0) AS rangs, coalesce(sum(vagues - suit) {before}, 0) - suit AS sauts FROM jointes),
chained AS (
  SELECT c.* EXCEPT (segment, avant, position, vague), CAST(c.position + s.rangs AS INT) AS position, c.vague + s.sauts AS vague
  FROM scanned c JOIN suite s USING ({FAMILY}, segment)),
"""



def family_sql(levels: tuple[int, ...] = (8,), span: int = 0) -> str:
    """Common table expressions over the relations of a star, Spark SQL: ``chained`` has a row a dated market of a family
    (wave, expiry, its first winner), ``families`` a row a family with its last market.  With
    ``span`` days, time lines are cut into segments."""
    level = ", ".join(map(str, levels))
    return f"""WITH acheteurs AS (SELECT * FROM {{acheteurs}}), entreprises AS (SELECT * FROM {{entreprises}}), marches AS (SELECT * FROM {{marches}}),
attributions AS (SELECT * FROM {{attributions}}),
winners AS (
  SELECT a.uid, min(a.siren) AS siren, min_by(e.denomination, a.siren) AS denomination
  FROM attributions a JOIN entreprises e ON a.siren = e.siren GROUP BY a.uid),
medians AS (
  SELECT code_cpv, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(duree_mois AS DOUBLE)) AS mediane
  FROM {{tous}} WHERE duree_mois IS NOT NULL GROUP BY code_cpv),
levelled AS (
  SELECT m.siret_acheteur, m.uid, m.montant, m.date_notification, m.duree_restante_mois, w.siren, w.denomination, niveau, left(m.code_cpv, niveau) AS famille,
         CASE WHEN m.duree_mois IS NOT NULL THEN CAST(m.duree_mois AS DOUBLE) WHEN niveau = 8 THEN p.mediane END AS duree,
         CASE WHEN m.duree_mois IS NOT NULL THEN 'reelle' WHEN niveau = 8 AND p.mediane IS NOT NULL THEN 'inferee_famille_cpv' ELSE 'inconnue' END AS duree_source
  FROM marches m JOIN winners w ON m.uid = w.uid LEFT JOIN medians p ON m.code_cpv = p.code_cpv
  LATERAL VIEW explode(array({level})) l AS niveau
  WHERE m.date_notification IS NOT NULL),
{_segmented(span) if span else _CHAIN}vagues AS (
  SELECT {FAMILY}, vague, min(date_notification) AS debut, max(fin) AS fin, count(*) AS nb,
         min(struct(-unix_date(date_notification) AS jour, siren, uid, denomination, date_notification, fin, duree_source, duree_restante_mois)) AS dernier
         {', 0 AS uids' if span else ', collect_list(struct(-unix_date(date_notification) AS jour, siren, uid)) AS uids'}
  FROM chained GROUP BY {FAMILY}, vague),
suivies AS (SELECT *, lead(debut) OVER (PARTITION BY {FAMILY} ORDER BY vague) AS suivante FROM vagues),
mesurees AS (
  SELECT {FAMILY}, sum(nb) AS nb_marches, count(*) AS nb_vagues, min(dernier) AS d,
         {'CAST(NULL AS ARRAY<STRING>)' if span else 'transform(array_sort(flatten(collect_list(uids))), x -> x.uid)'} AS marches_support,
         count_if(fin IS NOT NULL AND suivante IS NOT NULL) AS transitions,
         count_if(abs(12 * (year(suivante) - year(fin)) + (month(suivante) - month(fin)) + (day(suivante) - day(fin)) / 30.44) <= 6) AS coherentes
  FROM suivies GROUP BY {FAMILY}),
{_NEWEST if span else ''}familles AS (
  SELECT {'m.* EXCEPT (marches_support), n.marches_support' if span else 'm.*'}, CASE WHEN transitions > 0 THEN CAST(coherentes AS DOUBLE) / transitions END AS ratio
  FROM mesurees m {f'JOIN recents n USING ({FAMILY})' if span else ''}),
families AS (
  SELECT {FAMILY}, nb_marches, nb_vagues, transitions, coherentes, ratio, marches_support, d.siren AS siren_sortant, d.denomination AS sortant,
         d.uid AS uid_dernier, d.date_notification AS date_dernier, d.fin AS date_expiration, d.duree_source, d.duree_restante_mois,
         CASE WHEN nb_vagues <= 1 OR ratio IS NULL THEN 'faible' WHEN nb_vagues >= 3 AND ratio >= 0.7 THEN 'élevée'
              WHEN ratio >= 0.5 THEN 'moyenne' ELSE 'faible' END AS confiance
  FROM familles)
"""
