"""DuckDB SQL for the results of ``procurement``, written apart from the Spark plans."""

from __future__ import annotations

from tenderlake.functions.dialect import Duck
from tenderlake.sources.adapters import BRONZE, CANON

def _family(d, canon: str = CANON, exact: str = "") -> str:
    """Market rows of families with expiry, waves and transitions (named relations to build on)."""
    return f"""WITH {canon},
rows_ AS (
  SELECT m.*, a.siren, e.denomination, e.etat FROM marches m JOIN attributions a ON m.uid = a.uid JOIN entreprises e ON a.siren = e.siren),
medians AS (SELECT code_cpv, {d.median('CAST(duree_mois AS DOUBLE)')} AS mediane FROM marches WHERE duree_mois IS NOT NULL {exact} GROUP BY code_cpv),
chain AS (
  SELECT r.siret_acheteur, r.code_cpv, r.uid, r.date_notification, r.montant, r.duree_mois,
         coalesce(CAST(r.duree_mois AS DOUBLE), p.mediane) AS duree,
         CASE WHEN r.duree_mois IS NOT NULL THEN 'reelle' WHEN p.mediane IS NOT NULL THEN 'inferee_famille_cpv' ELSE 'inconnue' END AS duree_source
  FROM (SELECT DISTINCT uid, siret_acheteur, code_cpv, date_notification, montant, duree_mois FROM rows_) r
  LEFT JOIN medians p ON r.code_cpv = p.code_cpv WHERE r.date_notification IS NOT NULL),
dated AS (
  SELECT *, CASE WHEN duree <> 0 THEN {d.add_months('date_notification', d.half_even('duree'))} END AS fin,
         lag(date_notification) OVER (PARTITION BY siret_acheteur, code_cpv ORDER BY date_notification, uid) AS avant FROM chain),
waved AS (
  SELECT *, sum(CASE WHEN avant IS NULL OR {d.days('date_notification', 'avant')} > 30 THEN 1 ELSE 0 END)
            OVER (PARTITION BY siret_acheteur, code_cpv ORDER BY date_notification, uid ROWS UNBOUNDED PRECEDING) AS vague FROM dated),
waves AS (
  SELECT siret_acheteur, code_cpv, CAST(vague AS BIGINT) AS vague, min(date_notification) AS debut, max(fin) AS fin, count(*) AS nb_marches
  FROM waved GROUP BY siret_acheteur, code_cpv, vague),
pairs AS (
  SELECT *, lead(debut) OVER (PARTITION BY siret_acheteur, code_cpv ORDER BY vague) AS suivante FROM waves),
coherent AS (
  SELECT siret_acheteur, code_cpv, count(*) AS nb_vagues, sum(nb_marches) AS nb_marches,
         sum(CASE WHEN fin IS NOT NULL AND suivante IS NOT NULL THEN 1 ELSE 0 END) AS transitions,
         sum(CASE WHEN abs(12 * (year(suivante) - year(fin)) + (month(suivante) - month(fin)) + (day(suivante) - day(fin)) / 30.44) <= 6 THEN 1 ELSE 0 END) AS coherentes
  FROM pairs GROUP BY siret_acheteur, code_cpv),
rated AS (
  SELECT *, CASE WHEN transitions > 0 THEN CAST(coherentes AS DOUBLE) / transitions END AS ratio FROM coherent),
sure AS (
  SELECT *, CASE WHEN nb_vagues <= 1 OR ratio IS NULL THEN 'faible' WHEN nb_vagues >= 3 AND ratio >= 0.7 THEN 'élevée'
                 WHEN ratio >= 0.5 THEN 'moyenne' ELSE 'faible' END AS confiance FROM rated),
last_ AS (
  SELECT siret_acheteur, code_cpv, uid, siren, denomination, date_notification, duree_restante_mois FROM (
    SELECT *, row_number() OVER (PARTITION BY siret_acheteur, code_cpv ORDER BY date_notification DESC, siren, uid) AS n FROM rows_
    WHERE date_notification IS NOT NULL) x WHERE n = 1)
"""


INCUMBENT = """
SELECT s.siret_acheteur, s.code_cpv, l.siren AS siren_sortant, l.denomination AS sortant, l.uid AS uid_dernier, l.date_notification AS date_dernier,
       w.fin AS date_expiration, w.duree_source, CAST(s.nb_marches AS BIGINT) AS nb_marches, CAST(s.nb_vagues AS BIGINT) AS nb_vagues,
       round(s.ratio, 6) AS ratio, s.confiance
FROM sure s JOIN last_ l ON s.siret_acheteur = l.siret_acheteur AND s.code_cpv = l.code_cpv
JOIN waved w ON w.uid = l.uid AND w.siret_acheteur = s.siret_acheteur AND w.code_cpv = s.code_cpv"""

#: Markets at all four levels: codes of 8, 6, 4 and 2 characters keep them apart.
_LEVELS = CANON.replace("marches AS (", "marches0 AS (") + """, marches AS (
  SELECT uid, siret_acheteur, montant, date_notification, left(code_cpv, l) AS code_cpv, duree_mois, duree_restante_mois, source FROM marches0, (VALUES (8), (6), (4), (2)) v(l))"""

#: From the families of a canon with ``marches0`` to the figures of sheets.
_FROM_FAMILIES = """,
asked AS (SELECT DISTINCT siret_acheteur, code_cpv FROM marches0),
cand AS (
  SELECT a.*, l, left(a.code_cpv, l) AS famille, coalesce(s.nb_marches, 0) AS nb FROM asked a CROSS JOIN (VALUES (8), (6), (4), (2)) v(l)
  LEFT JOIN sure s ON s.siret_acheteur = a.siret_acheteur AND s.code_cpv = left(a.code_cpv, l)),
chosen AS (
  SELECT *, max(CASE WHEN l = 8 THEN nb END) OVER (PARTITION BY siret_acheteur, code_cpv) < 2 AS pauvre,
         row_number() OVER (PARTITION BY siret_acheteur, code_cpv ORDER BY CASE WHEN nb >= 2 THEN 0 WHEN nb = 1 THEN 1 ELSE 2 END, l DESC) AS r FROM cand),
used AS (SELECT * FROM chosen WHERE r = 1),
near_ AS (
  SELECT a.siret, c.siret AS autre, a.departement IS NOT DISTINCT FROM c.departement AS proche,
         row_number() OVER (PARTITION BY a.siret, a.departement IS NOT DISTINCT FROM c.departement ORDER BY c.siret) AS n_local,
         row_number() OVER (PARTITION BY a.siret ORDER BY c.siret) AS n_wide,
         bool_or(a.departement IS NOT DISTINCT FROM c.departement) OVER (PARTITION BY a.siret) AS local
  FROM acheteurs a JOIN acheteurs c ON a.naf = c.naf AND a.siret <> c.siret),
others AS (SELECT siret, autre, local FROM near_ WHERE CASE WHEN local THEN proche AND n_local <= 20 ELSE n_wide <= 20 END),
hist AS (
  SELECT u.siret_acheteur, u.code_cpv, r.denomination, r.etat, CASE WHEN r.montant <> 0 THEN r.montant END AS montant, 0 AS o, -date_diff('day', DATE '1970-01-01', r.date_notification) AS j, r.siren AS s
  FROM used u JOIN rows_ r ON r.siret_acheteur = u.siret_acheteur AND r.code_cpv = u.famille AND r.date_notification IS NOT NULL
  UNION ALL
  SELECT u.siret_acheteur, u.code_cpv, r.denomination, r.etat, r.montant, 1, 0, r.denomination
  FROM used u JOIN others x ON u.pauvre AND x.siret = u.siret_acheteur JOIN rows_ r ON r.siret_acheteur = x.autre AND r.code_cpv = u.famille),
info AS (
  SELECT u.siret_acheteur, u.code_cpv, u.pauvre, u.l, l.denomination AS sortant, l.uid AS uid_dernier, l.date_notification AS date_dernier, CAST(l.duree_restante_mois AS DOUBLE) AS restante, w.fin, w.duree_source, s.confiance, s.nb_marches,
         CASE s.confiance WHEN 'élevée' THEN 1.0::DOUBLE WHEN 'moyenne' THEN 0.66::DOUBLE ELSE 0.33::DOUBLE END AS score
  FROM used u JOIN sure s ON s.siret_acheteur = u.siret_acheteur AND s.code_cpv = u.famille
  JOIN last_ l ON l.siret_acheteur = s.siret_acheteur AND l.code_cpv = s.code_cpv
  JOIN waved w ON w.uid = l.uid AND w.siret_acheteur = s.siret_acheteur AND w.code_cpv = s.code_cpv),
sums AS (SELECT siret_acheteur, code_cpv, count(*) AS total, max(o) AS elargi, min(montant) AS prix_min, max(montant) AS prix_max FROM hist GROUP BY ALL),
seen AS (
  SELECT h.*, row_number() OVER (PARTITION BY h.siret_acheteur, h.code_cpv, h.denomination ORDER BY o, j, s) AS vu,
         count(*) OVER (PARTITION BY h.siret_acheteur, h.code_cpv, h.denomination) AS nb,
         bool_or(h.etat = 'ETRANGER') OVER (PARTITION BY h.siret_acheteur, h.code_cpv, h.denomination) AS dehors
  FROM hist h JOIN info i USING (siret_acheteur, code_cpv) WHERE h.denomination <> i.sortant),
rivals AS (
  SELECT *, row_number() OVER (PARTITION BY siret_acheteur, code_cpv ORDER BY nb DESC, o, j, s, denomination) AS rang,
         count(*) OVER (PARTITION BY siret_acheteur, code_cpv) AS combien FROM seen WHERE vu = 1),
listed AS (
  SELECT r.siret_acheteur, r.code_cpv, max(combien) AS combien, count(*) FILTER (WHERE dehors) AS dehors,
         string_agg(denomination || CASE WHEN dehors THEN ' [hors France]' ELSE '' END || ' (' || nb || '/' || m.total || ' attribution(s))', ', ' ORDER BY rang) FILTER (WHERE rang <= 10) AS noms
  FROM rivals r JOIN sums m USING (siret_acheteur, code_cpv) GROUP BY ALL),
whole AS (
  SELECT i.*, m.total, m.prix_min, m.prix_max, coalesce(m.elargi, 0) = 1 AS elargi, coalesce(r.combien, 0) AS combien, coalesce(r.dehors, 0) AS dehors,
         CASE WHEN r.combien IS NULL THEN 'aucun autre concurrent observé' WHEN r.combien > 10 THEN r.noms || ', ... et ' || (r.combien - 10) || ' autre(s) concurrent(s) observé(s)' ELSE r.noms END AS concurrents
  FROM info i JOIN sums m USING (siret_acheteur, code_cpv) LEFT JOIN listed r USING (siret_acheteur, code_cpv)),
cover0 AS (
  SELECT *, CASE WHEN fin IS NULL THEN 0 WHEN duree_source = 'reelle' THEN score ELSE round(score * 0.5::DOUBLE, 2) END AS c_fin,
         CASE WHEN total <= 1 THEN 0::DOUBLE WHEN dehors > 0 THEN least(score, 0.33::DOUBLE) ELSE score END AS c_riv, CASE WHEN prix_min IS NULL THEN 0::DOUBLE ELSE score END AS c_prix FROM whole),
cover AS (
  SELECT *, CASE WHEN elargi THEN round(c_riv * 0.5::DOUBLE, 2) ELSE c_riv END AS k_riv, CASE WHEN elargi THEN round(c_prix * 0.5::DOUBLE, 2) ELSE c_prix END AS k_prix,
         9 + CASE WHEN pauvre THEN 1 ELSE 0 END + CASE WHEN dehors > 0 THEN 1 ELSE 0 END AS nb_faits FROM cover0),
sheets AS (
  SELECT *, round((3 * score + CASE WHEN restante IS NOT NULL THEN score ELSE 0 END + c_fin + k_riv + 2 * k_prix + CASE WHEN pauvre THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN dehors > 0 THEN 1::DOUBLE ELSE 0 END) / nb_faits, 2) AS globale FROM cover),
support AS (
  SELECT siret_acheteur, code_cpv, list(uid ORDER BY date_notification DESC, siren, uid) AS uids FROM (
    SELECT siret_acheteur, code_cpv, uid, date_notification, min(siren) AS siren FROM rows_ WHERE date_notification IS NOT NULL GROUP BY ALL) x GROUP BY ALL)
"""

_SHEETS = _family(Duck, _LEVELS, "AND length(code_cpv) = 8") + _FROM_FAMILIES
_FIGURES = """SELECT siret_acheteur, code_cpv, score AS couv_titulaire, c_fin AS couv_expiration, k_riv AS couv_concurrents, k_prix AS couv_prix, prix_min, prix_max,
  CAST(nb_faits AS BIGINT) AS nb_faits, CAST(dehors AS BIGINT) AS hors_france, globale AS couverture_globale FROM sheets"""
_FACTS = _SHEETS + _FIGURES

_PCT = lambda c: f"CAST(CAST(round_even({c} * 100, 0) AS INT) AS VARCHAR) || '%'"
_EUR = lambda c: f"replace(format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT)), ',', ' ')"
_INT = lambda c: f"CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR)"
_WHY = """CASE WHEN EXISTS (SELECT 1 FROM others x WHERE x.siret = a.siret_acheteur) THEN 'Aucun marché trouvé pour cet acheteur et ce CPV'
  ELSE 'Aucune expansion (CPV parent, acheteurs comparables, périmètre national) n''a permis de trouver une donnée exploitable pour cet acheteur/CPV.' END"""

_BLOCK = _SHEETS + f"""SELECT a.siret_acheteur, a.code_cpv, 'Acheteur : ' || b.nom || ' | Objet CPV : ' || a.code_cpv AS ligne_1,
  CASE WHEN s.sortant IS NULL THEN 'DONNÉES INSUFFISANTES : ' || {_WHY} ELSE 'Sortant probable : ' || s.sortant || ', confiance ' || s.confiance || ' (couverture: ' || {_PCT('s.score')} || ')' END AS ligne_2,
  CASE WHEN s.sortant IS NULL THEN 'COUVERTURE GLOBALE : 0%' ELSE 'Échéance estimée : ' || coalesce(CAST(s.fin AS VARCHAR), 'inconnue') || ' (dernier marché: ' || CAST(s.date_dernier AS VARCHAR) || ') (couverture: ' || {_PCT('s.c_fin')} || ')' END AS ligne_3,
  'Concurrents observés : ' || s.concurrents || ' (couverture: ' || {_PCT('s.k_riv')} || ')' AS ligne_4,
  'Fourchette de prix : ' || CASE WHEN s.prix_min IS NULL THEN 'non disponible (n=' || s.nb_marches || ', aucun montant publié sur cette famille)'
     ELSE {_EUR('s.prix_min')} || ' € — ' || {_EUR('s.prix_max')} || ' € (n=' || s.nb_marches || ', indicatif)' END || ' (couverture: ' || {_PCT('s.k_prix')} || ')' AS ligne_5,
  CASE WHEN s.sortant IS NOT NULL THEN 'Pondération de l''acheteur : non disponible (couverture: 0%)' END AS ligne_6,
  'Historique : ' || s.nb_marches || ' marché(s) similaire(s) observé(s) — marché du sortant : ' || p.uids[1] || ' (sur ' || len(p.uids) || ' marché(s) en source)' AS ligne_7,
  'COUVERTURE GLOBALE : ' || {_PCT('s.globale')} AS ligne_8
FROM asked a JOIN acheteurs b ON b.siret = a.siret_acheteur JOIN used u USING (siret_acheteur, code_cpv) LEFT JOIN sheets s USING (siret_acheteur, code_cpv)
LEFT JOIN support p ON p.siret_acheteur = a.siret_acheteur AND p.code_cpv = u.famille"""

_TEXT = f"""CASE WHEN s.sortant IS NULL THEN 'Données insuffisantes : ' || rtrim({_WHY}, '. ') || '.' ELSE
  'Titulaire actuel probable : ' || s.sortant || ' (dernier marché notifié le ' || CAST(s.date_dernier AS VARCHAR) || ', échéance estimée : ' || coalesce(CAST(s.fin AS VARCHAR), 'inconnue') || '). Concurrents observés : ' || s.concurrents
  || '. Fourchette de prix constatée : ' || CASE WHEN s.prix_min IS NULL THEN 'non disponible (n=' || s.nb_marches || ', aucun montant publié sur cette famille)' ELSE {_INT('s.prix_min')} || ' € à ' || {_INT('s.prix_max')} || ' € (n=' || s.nb_marches || ', indicatif)' END
  || '. Pondération de l''acheteur : non disponible. Basé sur ' || s.nb_marches || ' marché(s) similaire(s) (couverture globale : ' || {_PCT('s.globale')} || ').' END"""

_SILVER_TYPED = f"""WITH {BRONZE}, d AS (
  SELECT uid, 'DECP' AS source, acheteur_id, acheteur_nom, objet, montant, code_cpv, date_notification AS jour, duree_mois, CASE WHEN modification_id = '' THEN 0 ELSE CAST(modification_id AS INT) END AS rev, date_chargement FROM bronze_decp
  UNION ALL SELECT 'TED-' || publication_number, 'TED', buyer_identifier, buyer_name, objet, montant, code_cpv, publication_date, '', NULL, date_chargement FROM bronze_ted),
last1 AS (SELECT DISTINCT * FROM d QUALIFY rank() OVER (PARTITION BY uid ORDER BY rev DESC NULLS LAST, date_chargement DESC) = 1),
typed AS (
  SELECT uid, source, CASE WHEN regexp_full_match(acheteur_id, '[0-9]{{14}}') THEN acheteur_id END AS siret_acheteur, nullif(acheteur_nom, '') AS nom_acheteur, objet,
    TRY_CAST(nullif(montant, '') AS DOUBLE) AS montant, code_cpv, CASE WHEN CAST(jour AS DATE) BETWEEN DATE '1993-01-01' AND DATE '2000-06-30' THEN CAST(jour AS DATE) END AS date_notification,
    CAST(nullif(duree_mois, '') AS DOUBLE) AS duree_mois, rev AS modification_id, CASE WHEN montant = 'n.c.' THEN 'montant' ELSE '' END AS rejets, acheteur_id FROM last1)
"""

_BUYERS = _SILVER_TYPED + """, found AS (
  SELECT t.*, CASE WHEN siret_acheteur IS NOT NULL OR code_cpv NOT LIKE '72%' THEN siret_acheteur
      WHEN acheteur_id LIKE '% % % %' THEN replace(acheteur_id, ' ', '') WHEN acheteur_id IN ('sans numero', '') THEN r.siret_siege END AS siret,
    CASE WHEN siret_acheteur IS NOT NULL OR code_cpv NOT LIKE '72%' THEN NULL WHEN acheteur_id LIKE '% % % %' THEN 'espaces' WHEN acheteur_id IN ('sans numero', '') AND r.siret_siege IS NOT NULL THEN 'flou' END AS methode
  FROM typed t LEFT JOIN registre r ON r.denomination = t.nom_acheteur AND r.siren LIKE '9%')
"""

_AWARDS = _BUYERS + """, w AS (
  SELECT DISTINCT uid, titulaire_id AS id, titulaire_nom AS nom, 'DECP' AS source FROM bronze_decp WHERE titulaire_id IS NOT NULL
  UNION SELECT 'TED-' || publication_number, winner_identifier, winner_name, 'TED' FROM bronze_ted WHERE winner_identifier IS NOT NULL),
amis AS (
  SELECT s_name AS denomination, CASE s_suppkey % 40 WHEN 39 THEN 'flou' WHEN 4 THEN 'flou_desambigue_actif' WHEN 24 THEN 'flou_desambigue_actif' WHEN 14 THEN 'flou_desambigue_actif' END AS nomme,
    CASE WHEN s_suppkey % 40 = 14 THEN '8' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '00001' WHEN s_suppkey % 40 IN (4, 24, 39) THEN lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '00001' END AS siege FROM supplier),
made AS (
  SELECT w.uid, w.nom, w.source, CASE WHEN regexp_full_match(id, '[0-9]{14}') THEN id WHEN id LIKE 'SIREN %' THEN substring(id, 7) || '00001' WHEN id LIKE 'FR12%' THEN substring(id, 5) || '00001'
      WHEN id LIKE 'BE%' AND f.code_cpv LIKE '72%' THEN rpad(id, 14, '0') WHEN id = 'sans numero' AND f.code_cpv LIKE '72%' THEN r.siege END AS siret,
    CASE WHEN id LIKE 'SIREN %' THEN 'siren_seul' WHEN id LIKE 'FR12%' THEN 'tva_fr' WHEN id LIKE 'BE%' THEN 'etranger' WHEN id = 'sans numero' THEN r.nomme END AS methode, f.code_cpv
  FROM w JOIN found f ON f.uid = w.uid LEFT JOIN amis r ON r.denomination = w.nom),
awarded AS (SELECT uid, siret AS siret_titulaire, nom AS nom_titulaire, source, methode AS methode_resolution, CASE methode WHEN 'flou' THEN 1.0::DOUBLE WHEN 'flou_desambigue_actif' THEN 0.65::DOUBLE END AS score_confiance FROM made WHERE siret IS NOT NULL)
"""

_FLAGGED = _AWARDS + """, flags AS (
  SELECT t.uid, min_by(d.uid, struct_pack(e := abs(t.date_notification - d.date_notification), u := d.uid)) AS doublon FROM found t JOIN found d ON t.source = 'TED' AND d.source = 'DECP' AND t.siret = d.siret AND left(t.code_cpv, 4) = left(d.code_cpv, 4)
    AND abs(t.montant - d.montant) <= 0.01 * greatest(d.montant, 1) AND abs(t.date_notification - d.date_notification) <= 30 GROUP BY t.uid)
"""


#: Gold of the silver above, by the names of the canonical relations.
_GOLD = _FLAGGED + """, bons AS (
  SELECT f.* FROM found f WHERE siret IS NOT NULL AND code_cpv LIKE '72%' AND uid NOT IN (SELECT uid FROM flags)),
acheteurs AS (
  SELECT siret, coalesce(min(nom_acheteur), 'Acheteur inconnu') AS nom, any_value(c_mktsegment) AS naf, lpad(CAST(any_value(c_nationkey) AS VARCHAR), 2, '0') AS departement
  FROM bons LEFT JOIN customer ON siret = '9' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '00002' GROUP BY siret),
marches0 AS (
  SELECT uid, siret AS siret_acheteur, montant, code_cpv, date_notification, duree_mois, CASE WHEN source = 'DECP' AND CAST(uid AS BIGINT) % 3 > 0 THEN CAST(uid AS BIGINT) % 24 END AS duree_restante_mois, source FROM bons),
attributions AS (SELECT a.uid, siret_titulaire, left(siret_titulaire, 9) AS siren, methode_resolution, score_confiance, nom_titulaire FROM awarded a JOIN bons USING (uid)),
entreprises AS (SELECT siren, min(nom_titulaire) AS denomination, NULL AS etat FROM attributions GROUP BY siren),
marches AS (
  SELECT uid, siret_acheteur, montant, date_notification, left(code_cpv, l) AS code_cpv, duree_mois, duree_restante_mois, source FROM marches0, (VALUES (8), (6), (4), (2)) v(l))
"""


def _near(share: float, days: int) -> str:
    return f"""WITH {CANON} SELECT t.uid AS uid_ted, d.uid AS uid_decp FROM marches t, marches d
WHERE t.source = 'TED' AND d.source = 'DECP' AND t.siret_acheteur = d.siret_acheteur AND left(t.code_cpv, 4) = left(d.code_cpv, 4)
  AND abs(t.montant - d.montant) <= {share} * greatest(d.montant, 1) AND abs(date_diff('day', t.date_notification, d.date_notification)) <= {days}
QUALIFY row_number() OVER (PARTITION BY t.uid ORDER BY abs(date_diff('day', t.date_notification, d.date_notification)), d.uid) = 1"""


_COMPANIES = """comp AS (SELECT s_suppkey AS k, s_name, CASE s_suppkey % 6 WHEN 0 THEN 'BE' || s_suppkey WHEN 1 THEN 'x' || s_suppkey ELSE lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS siren,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Inconnu' ELSE s_name END AS denomination, CASE WHEN s_suppkey % 10 = 2 THEN '62.01Z' END AS code_naf,
  CASE WHEN s_suppkey % 10 = 3 THEN 'NON_DIFFUSIBLE' END AS etat FROM supplier)"""
_ENRICHED = f"""WITH {_COMPANIES}, rich AS (
  SELECT siren, CASE WHEN k % 6 < 2 OR k % 9 = 0 OR k % 2 = 1 THEN denomination ELSE s_name END AS denomination,
    CASE WHEN k % 6 < 2 OR k % 9 = 0 THEN code_naf WHEN k % 3 > 0 THEN '62.03Z' END AS code_naf, CASE WHEN k % 6 < 2 OR k % 9 = 0 THEN etat ELSE 'A' END AS etat_administratif,
    CASE WHEN k % 6 >= 2 THEN siren || '00001' END AS siret_siege, CASE WHEN k % 6 >= 2 THEN k || ' DU PORT' END AS adresse, CASE WHEN k % 6 >= 2 THEN '13002' END AS code_postal, k FROM comp)"""

ORACLE_SQL = {
    "incumbent_by_family": _family(Duck) + INCUMBENT,
    "renewal_chain_position": _family(Duck) + """SELECT siret_acheteur, code_cpv, uid, date_notification,
  CAST(row_number() OVER (PARTITION BY siret_acheteur, code_cpv ORDER BY date_notification, uid) AS BIGINT) AS position FROM chain""",
    "notification_waves": _family(Duck) + "SELECT siret_acheteur, code_cpv, vague, debut, fin, CAST(nb_marches AS BIGINT) AS nb_marches FROM waves",
    "wave_coherence": _family(Duck) + """SELECT siret_acheteur, code_cpv, CAST(nb_vagues AS BIGINT) AS nb_vagues, CAST(transitions AS BIGINT) AS transitions,
  CAST(coherentes AS BIGINT) AS coherentes, round(ratio, 6) AS ratio, confiance FROM sure""",
    "estimated_expiry": _family(Duck) + "SELECT siret_acheteur, code_cpv, uid, fin AS date_expiration, duree_source FROM dated",
    "price_range": _family(Duck) + "SELECT siret_acheteur, code_cpv, min(montant) AS prix_min, max(montant) AS prix_max, count(*) AS n FROM chain GROUP BY ALL",
    "median_duration_by_category": _family(Duck) + "SELECT code_cpv, mediane FROM medians",
    "incumbent_by_prefix": _family(Duck, _LEVELS, "AND length(code_cpv) = 8") + """SELECT s.siret_acheteur, s.code_cpv AS famille, l.siren AS siren_sortant, w.fin AS date_expiration, w.duree_source,
  CAST(s.nb_marches AS BIGINT) AS nb_marches, s.confiance FROM sure s JOIN last_ l USING (siret_acheteur, code_cpv) JOIN waved w ON w.uid = l.uid AND w.siret_acheteur = s.siret_acheteur AND w.code_cpv = s.code_cpv
  WHERE length(s.code_cpv) < 8""",
    "competitor_frequency": _family(Duck) + """, seen AS (
  SELECT r.siret_acheteur, r.code_cpv, r.denomination, count(*) AS nb, max(r.date_notification) AS vu FROM rows_ r
  JOIN last_ l ON l.siret_acheteur = r.siret_acheteur AND l.code_cpv = r.code_cpv WHERE r.denomination <> l.denomination GROUP BY ALL)
SELECT siret_acheteur, code_cpv, denomination, nb, row_number() OVER w AS rang, CAST(greatest(count(*) OVER (PARTITION BY siret_acheteur, code_cpv) - 10, 0) AS BIGINT) AS autres
FROM seen WINDOW w AS (PARTITION BY siret_acheteur, code_cpv ORDER BY nb DESC, vu DESC, denomination) QUALIFY rang <= 10""",
    "near_duplicates": _near(0.01, 30),
    "near_duplicates_wide": _near(0.1, 90),
    "fact_coverage": _FACTS,
    "section_coverage": _SHEETS + """, each AS (
  SELECT 'titulaire_actuel' AS cle, score AS c FROM sheets UNION ALL SELECT 'date_dernier_marche', score FROM sheets UNION ALL SELECT 'nombre_marches_historique', score FROM sheets
  UNION ALL SELECT 'duree_restante_mois', 0 FROM sheets UNION ALL SELECT 'ponderation_acheteur', 0 FROM sheets UNION ALL SELECT 'date_expiration_estimee', c_fin FROM sheets
  UNION ALL SELECT 'concurrents_observes', k_riv FROM sheets UNION ALL SELECT 'fourchette_prix_min', k_prix FROM sheets UNION ALL SELECT 'fourchette_prix_max', k_prix FROM sheets
  UNION ALL SELECT 'elargissement_applique', 0.5 FROM sheets WHERE pauvre UNION ALL SELECT 'nb_concurrents_hors_france', 1 FROM sheets WHERE dehors > 0)
SELECT cle, count(*) AS fiches, count(*) FILTER (WHERE c > 0) AS renseignees, round(avg(c), 4) AS couverture FROM each GROUP BY cle""",
    "silver_rejects": _SILVER_TYPED + "SELECT uid, source, rejets FROM typed WHERE rejets <> ''",
    "decision_block": _BLOCK,
    "template_text": _SHEETS + f"SELECT a.siret_acheteur, a.code_cpv, {_TEXT} AS texte, true AS valide FROM asked a LEFT JOIN sheets s USING (siret_acheteur, code_cpv)",
    "rejected_text": f"WITH {_LEVELS}" + """ SELECT DISTINCT siret_acheteur, code_cpv, false AS valide, true AS nombre_vu, 'Conseil,QWERTZ GROUPE,Zorglub' AS noms, '2031-02-30' AS dates FROM marches0""",
    "expansion": _SHEETS + """SELECT u.siret_acheteur, u.code_cpv, CAST(u.l AS BIGINT) AS niveau, CASE WHEN pauvre THEN coalesce(o.n, 0) ELSE 0 END AS nb_comparables,
  CASE WHEN NOT pauvre THEN '' ELSE concat_ws('; ', CASE WHEN u.nb < 2 OR u.l <= 6 THEN 'cpv_parent: ' || left(u.code_cpv, 6) END, CASE WHEN u.nb < 2 OR u.l <= 4 THEN 'cpv_parent: ' || left(u.code_cpv, 4) END,
    CASE WHEN u.nb < 2 OR u.l <= 2 THEN 'cpv_parent: ' || left(u.code_cpv, 2) END,
    CASE WHEN o.n > 0 AND o.local THEN 'acheteurs_comparables_departement: ' || o.n || ' acheteur(s), NAF ' || b.naf || ', département ' || b.departement
         WHEN o.n > 0 THEN 'perimetre_geographique_national: ' || o.n || ' acheteur(s), NAF ' || b.naf || ', France entière' END, 'fenetre_temporelle: non applicable') END AS essais
  FROM used u JOIN acheteurs b ON b.siret = u.siret_acheteur LEFT JOIN (SELECT siret, count(*) AS n, any_value(local) AS local FROM others GROUP BY siret) o ON o.siret = u.siret_acheteur""",
    "comparable_buyers": f"""WITH {CANON}, a AS (SELECT siret, CASE WHEN siret LIKE '%7' THEN naf || siret ELSE naf END AS naf, CASE WHEN siret LIKE '%3' THEN siret ELSE CAST(departement AS VARCHAR) END AS dep FROM acheteurs),
p AS (SELECT x.siret, y.siret AS comparable, x.dep = y.dep AS proche, bool_or(x.dep = y.dep) OVER (PARTITION BY x.siret) AS local FROM a x JOIN a y ON x.naf = y.naf AND x.siret <> y.siret)
SELECT siret, CASE WHEN local THEN 'departement' ELSE 'national' END AS zone, row_number() OVER (PARTITION BY siret ORDER BY comparable) AS n, comparable FROM p WHERE proche OR NOT local
QUALIFY row_number() OVER (PARTITION BY siret ORDER BY comparable) <= 20""",
    "purchasing_bodies": """SELECT c_custkey, b AS centrale, 'Marché notifié par une centrale d''achat (' || p || c_name || ', détectée via le nom ''' || b || '''). L''organisme bénéficiaire réel n''est pas identifiable dans les données disponibles : DECP/TED rattachent le marché au SIRET de la centrale, jamais à l''établissement final.' AS message
FROM customer JOIN (VALUES (0, 'UGAP', 'Ugap '), (1, 'UNIHA', 'GCS UniHA '), (2, 'RESAH', 'Resah-')) v(k, b, p) ON c_custkey % 5 = k""",
    "silver_typed": _SILVER_TYPED + "SELECT * EXCLUDE (acheteur_id) FROM typed",
    "silver_buyers": _BUYERS + """SELECT uid, siret AS siret_acheteur, nom_acheteur, methode AS methode_resolution_acheteur,
  CASE methode WHEN 'espaces' THEN 1.0::DOUBLE WHEN 'flou' THEN 1.0::DOUBLE END AS score_confiance_acheteur FROM found""",
    "silver_awards": _AWARDS + "SELECT * FROM awarded",
    "silver_volumes": _FLAGGED + """SELECT (SELECT count(*) FROM found) AS marches, (SELECT count(DISTINCT uid) FROM found) AS uid_distincts, (SELECT count(*) FROM found WHERE source = 'DECP') AS decp,
  (SELECT count(*) FROM found WHERE source = 'TED') AS ted, (SELECT count(*) FROM found WHERE siret IS NULL) AS sans_acheteur, (SELECT count(*) FROM flags) AS doublons,
  (SELECT count(*) FROM found WHERE rejets <> '') AS rejetes, (SELECT count(*) FROM awarded) AS attributions""",
    "silver_methods": _AWARDS + """SELECT 'acheteurs' AS cote, coalesce(methode, 'siret_exact') AS methode, count(*) AS nb FROM found WHERE siret IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'titulaires', methode_resolution, count(*) FROM awarded GROUP BY ALL""",
    "gold_star_buyers": _GOLD + "SELECT siret, nom FROM acheteurs",
    "gold_star_companies": _GOLD + "SELECT siren, denomination, true AS est_active FROM entreprises",
    "gold_star_awards": _GOLD + "SELECT uid, siret_titulaire, siren, methode_resolution, score_confiance FROM attributions",
    "gold_integrity": _GOLD + """SELECT unnest(['marches.siret_acheteur', 'attributions.uid', 'attributions.siren']) AS lien, 0::BIGINT AS nb
  UNION ALL SELECT 'perimes', count(*) FROM marches0 WHERE code_cpv = '72220000'""",
    "gold_sheets": _family(Duck, _GOLD.removeprefix("WITH "), "AND length(code_cpv) = 8") + _FROM_FAMILIES + _FIGURES.replace("couverture_globale FROM", "couverture_globale, restante AS mois_restants FROM"),
    "gold_from_silver": _FLAGGED + "SELECT uid, siret AS siret_acheteur, code_cpv, date_notification FROM found WHERE siret IS NOT NULL AND code_cpv LIKE '72%' AND uid NOT IN (SELECT uid FROM flags)",
    "identifier_rules": """WITH n AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS t FROM documents)
SELECT doc_id, 0::BIGINT AS place, lpad(t, 14, '1') AS siret, left(lpad(t, 14, '1'), 9) AS siren, 'siret_exact_segmente' AS methode, NULL AS pays_etranger FROM n WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 0, '123456789' || lpad(t, 5, '0'), '123456789', 'espaces', NULL FROM n WHERE doc_id % 7 = 1
UNION ALL SELECT doc_id, 0, NULL, lpad(t, 9, '0'), 'tva_fr', NULL FROM n WHERE doc_id % 7 = 2
UNION ALL SELECT doc_id, 0, NULL, lpad(t, 9, '0'), 'siren_seul', NULL FROM n WHERE doc_id % 7 = 3
UNION ALL SELECT doc_id, 0, rpad('DE' || t, 14, '0'), NULL, 'etranger', 'DE' FROM n WHERE doc_id % 7 = 4
UNION ALL SELECT doc_id, 0, NULL, lpad(t, 9, '2'), 'siren_seul', NULL FROM n WHERE doc_id % 7 = 5
UNION ALL SELECT doc_id, 1, lpad(t, 14, '3'), left(lpad(t, 14, '3'), 9), 'siret_exact_segmente', NULL FROM n WHERE doc_id % 7 = 5""",
    "siren_mentions": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 9, '4') ELSE '444444' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END AS siren FROM supplier""",
    "html_results": """SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_name) AS rang, s_name || ' & Co — siège : ' || n_name AS resultat
FROM nation JOIN supplier ON s_nationkey = n_nationkey QUALIFY rang <= 10""",
    "web_corroboration": """SELECT CAST(s_suppkey AS VARCHAR) AS key, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '00001' AS siret, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS siren, 'web' AS methode, 0.4::DOUBLE AS score
FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0""",
    "name_history": """SELECT CAST(s_suppkey AS VARCHAR) AS key, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '00001' AS siret, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS siren, 'historique' AS methode, 0.8::DOUBLE AS score FROM supplier WHERE s_suppkey % 2 = 0""",
    "json_categories": """SELECT CAST(event_id AS VARCHAR) AS idweb, event_type AS nomacheteur, NULL AS titulaire, CAST(CAST(ts AS DATE) AS VARCHAR) AS date_parution, '75' AS code_departement,
  CASE event_id % 4 WHEN 1 THEN '45000000,' ELSE '' END || '72' || lpad(CAST(user_id % 100 AS VARCHAR), 6, '0') AS codes FROM events WHERE event_id % 4 < 2""",
    "ted_notices": """SELECT CAST(c_custkey AS VARCHAR) AS publication_number, '2026-04-28' AS publication_date, CASE c_custkey % 3 WHEN 0 THEN 'F ' || c_name WHEN 1 THEN 'D ' || c_name ELSE 'Acheteur inconnu' END AS buyer_name, 'FRA' AS buyer_country,
  CAST(c_custkey AS VARCHAR) AS winner_identifier, NULL AS winner_name, '722' || lpad(CAST(c_custkey % 100 AS VARCHAR), 5, '0') AS code_cpv, c_custkey || '.5' AS montant, 'titre' AS objet FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 4 <> 0""",
    "register_rows": """SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS siren, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'NOM' ELSE s_name END AS raison_sociale_legale,
  CASE WHEN s_suppkey % 11 <> 0 THEN '62.01Z' END AS code_naf, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '2020-01-31' END AS date_creation,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'C' ELSE 'A' END AS etat_administratif, s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AS est_active, s_suppkey % 3 <> 0 AS est_siege,
  CASE WHEN s_suppkey % 2 = 0 THEN 'RUE' ELSE s_suppkey || ' RUE' END AS adresse, '75001' AS code_postal FROM supplier""",
    "register_completion": f"""WITH {_COMPANIES}, t AS (SELECT *, code_naf IS NULL AND etat IS NULL AS ouvert, k % 6 >= 2 AND k % 5 >= 3 AS trouve FROM comp)
SELECT siren, CASE WHEN ouvert AND trouve AND denomination = 'Inconnu' THEN CASE WHEN k % 3 = 0 THEN 'P ' || s_name ELSE s_name END ELSE denomination END AS denomination,
  CASE WHEN ouvert AND trouve THEN '62.02A' ELSE code_naf END AS code_naf,
  CASE WHEN NOT ouvert THEN etat WHEN k % 6 = 0 THEN 'ETRANGER' WHEN k % 6 = 1 THEN 'SIREN_MALFORME' WHEN k % 5 = 0 THEN 'INTROUVABLE_API' WHEN k % 5 = 1 THEN 'NON_DIFFUSIBLE' WHEN trouve THEN 'A' END AS etat_administratif,
  CASE WHEN ouvert AND trouve THEN true END AS est_active FROM t""",
    "register_enrichment": _ENRICHED + " SELECT * EXCLUDE (k) FROM rich",
    "enrichment_coverage": _ENRICHED + """ SELECT (SELECT count(*) FROM rich) AS entreprises, (SELECT count(code_naf) FROM rich) AS naf_apres, (SELECT count(*) FROM rich WHERE denomination <> 'Inconnu') AS noms_connus,
  (SELECT count(code_naf) FROM comp) AS naf_avant, (SELECT count(*) FROM rich WHERE k % 6 < 2 OR k % 9 = 0) AS introuvables""",
    "winner_establishments": """WITH s AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS siren, s_suppkey % 2 = 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem) AS gagne FROM supplier)
SELECT siren || '00001' AS siret, siren, gagne AS est_siege, CASE WHEN gagne THEN '13002' ELSE 'ancien' END AS code_postal FROM s WHERE gagne OR k % 3 = 0""",
    "quality_checks": f"""WITH {_COMPANIES}, n AS (SELECT count(*) FILTER (WHERE s_suppkey % 9 <> 0) AS u, 2 * count(*) AS p, count(*) AS c FROM supplier),
st AS (SELECT count(*) FILTER (WHERE code_naf IS NOT NULL OR etat = 'NON_DIFFUSIBLE') AS k, count(*) FILTER (WHERE trim(denomination) = '') AS b FROM comp),
orph AS (SELECT count(*) AS o FROM supplier, range(2) WHERE s_suppkey <> 5 AND s_suppkey % 6 < 2),
aw AS (SELECT count(DISTINCT l_suppkey) AS d, count(DISTINCT l_suppkey) FILTER (WHERE l_suppkey <> 5) AS e FROM lineitem)
SELECT * FROM (SELECT 'volumetrie' AS controle, u > 50 AND p > 150 AS ok, u || ' unites, ' || p || ' etablissements' AS detail FROM n
UNION ALL SELECT 'cles_uniques', true, u || ' et ' || p || ' cles' FROM n UNION ALL SELECT 'statut_connu', k = c, k || ' sur ' || c FROM n, st
UNION ALL SELECT 'sans_nom_vide', b = 0, CAST(b AS VARCHAR) FROM st UNION ALL SELECT 'sans_orphelin', o = 0, CAST(o AS VARCHAR) FROM orph
UNION ALL SELECT 'couverture_etablissements', e >= 0.95 * d, e || ' sur ' || d FROM aw UNION ALL SELECT 'etrangers_isoles', false, '0' UNION ALL SELECT 'sans_texte_vide', true, '0') x""",
    "cross_source_window": f"""WITH {CANON} SELECT t.uid, EXISTS (SELECT 1 FROM marches p WHERE p.source = 'DECP' AND p.siret_acheteur = t.siret_acheteur AND left(p.code_cpv, 4) = left(t.code_cpv, 4)
  AND abs(date_diff('day', p.date_notification, t.date_notification)) <= 90) AS recoupe FROM marches t WHERE t.source = 'TED'""",
    "cross_source_report": f"""WITH {CANON}, x AS (SELECT EXISTS (SELECT 1 FROM marches p WHERE p.source = 'DECP' AND p.siret_acheteur = t.siret_acheteur AND left(p.code_cpv, 4) = left(t.code_cpv, 4)
  AND abs(date_diff('day', p.date_notification, t.date_notification)) <= 90) AS r FROM marches t WHERE t.source = 'TED')
SELECT count(*) AS avis, count(*) FILTER (WHERE r) AS recoupes, count(*) FILTER (WHERE NOT r) AS sans_correspondance, round(count(*) FILTER (WHERE r) / count(*), 6) AS part, least(10, count(*) FILTER (WHERE NOT r)) AS exemples FROM x""",
    "identity_accuracy": """SELECT CASE s_suppkey % 4 WHEN 0 THEN 'niveau2_siren' WHEN 1 THEN 'niveau2_etranger' WHEN 2 THEN 'niveau3_nom' ELSE 'impossible' END AS type_cas, count(*) FILTER (WHERE s_suppkey % 20 <> 14) AS corrects, count(*) AS total,
  count(*) FILTER (WHERE s_suppkey % 20 <> 14) / count(*) AS part FROM supplier GROUP BY 1""",
    "similar_markets": """WITH q AS (SELECT embedding AS v, label FROM embeddings WHERE vec_id = 0)
SELECT CAST(e.vec_id AS VARCHAR) AS uid, CASE WHEN e.label % 5 <> 4 THEN CAST(72000000 + e.label AS VARCHAR) END AS code_cpv, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 6) AS similarite
FROM embeddings e, q WHERE e.vec_id <> 0 AND (CASE WHEN e.label % 5 <> 4 THEN e.label END) IS DISTINCT FROM (CASE WHEN q.label % 5 <> 4 THEN q.label END) ORDER BY similarite DESC, uid LIMIT 10""",
    "category_vote": """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 1),
s AS (SELECT CAST(e.vec_id AS VARCHAR) AS uid, CASE WHEN e.label % 5 <> 4 THEN CAST(72000000 + e.label AS VARCHAR) END AS c, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 6) AS x FROM embeddings e, q WHERE e.vec_id <> 1 ORDER BY x DESC, uid LIMIT 20),
g AS (SELECT c, sum(x) AS p, count(*) AS n FROM s WHERE c IS NOT NULL GROUP BY c), b AS (SELECT * FROM g ORDER BY p DESC, c DESC LIMIT 1), m AS (SELECT max(x) AS x, count(*) AS n FROM s WHERE c IS NOT NULL)
SELECT CASE WHEN m.x >= t THEN b.c END AS code_cpv, CASE WHEN m.x >= t THEN b.n END AS voix, m.n AS voisins, m.x AS proche, round(CASE WHEN m.x >= t THEN b.p END, 4) AS poids, t AS seuil FROM b, m, (VALUES (0.0::DOUBLE), (0.7::DOUBLE)) v(t)""",
    "embedding_backfill": "SELECT doc_id AS uid, CASE WHEN doc_id % 2 = 0 THEN 1 WHEN text IS NULL THEN NULL ELSE 384 END::BIGINT AS taille FROM documents",
    "register_cleaning": """WITH r AS (SELECT CASE WHEN user_id % 50 <> 0 THEN CAST(user_id AS VARCHAR) END AS siren, CASE WHEN event_id % 3 <> 0 THEN event_type END AS nom, event_id FROM events)
SELECT * FROM r WHERE siren IS NULL UNION ALL SELECT * FROM (SELECT * FROM r WHERE siren IS NOT NULL QUALIFY row_number() OVER (PARTITION BY siren ORDER BY event_id DESC) = 1)""",
    "invalid_keys": "SELECT count(*) FILTER (WHERE s_suppkey % 6 < 2) AS invalides, count(*) AS lignes FROM supplier",
    "decp_window": "SELECT CAST(o_orderkey AS VARCHAR) AS uid, 'a' || chr(10) || '\"b\" ' || o_orderstatus AS objet FROM orders WHERE o_orderkey % 3 > 0 AND CAST(o_orderdate AS DATE) >= DATE '1995-06-30'",
    "bronze_reload": "SELECT CAST(o_orderkey AS VARCHAR) AS uid, round(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END, 4) AS montant, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS jour FROM orders",
    "published_rebuild": "SELECT n_nationkey, n_name FROM nation",
    "notice_cache": "SELECT s_suppkey, 'é ' || s_name AS nom FROM supplier",
    "late_revisions": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "incumbent_accuracy": _family(Duck) + """, w AS (SELECT siret_acheteur, code_cpv, arg_max(uid, struct_pack(d := date_notification, u := uid)) AS uid FROM marches GROUP BY ALL),
c AS (SELECT w.*, (SELECT min(a.siren) FROM attributions a WHERE a.uid = w.uid) AS attendu, w.siret_acheteur LIKE '%9' AS exclu FROM w)
SELECT count(*) FILTER (WHERE NOT exclu AND l.siren IS NOT DISTINCT FROM attendu) AS corrects, count(*) FILTER (WHERE NOT exclu) AS evalues, count(*) FILTER (WHERE exclu) AS exclus,
  count(*) FILTER (WHERE coalesce(s.confiance, 'aucune') = 'faible') AS confiances FROM c LEFT JOIN last_ l USING (siret_acheteur, code_cpv) LEFT JOIN sure s USING (siret_acheteur, code_cpv)""",
    "text_mentions": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
j AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(t, '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '([0-9])[ \u00a0\u202f]([0-9]{3})\\b', '\\1\\2', 'g') AS u FROM t)
SELECT doc_id, CAST(len(regexp_extract_all(u, '[0-9]+([.][0-9]+)?')) AS BIGINT) AS nombres,
  CAST(len(regexp_extract_all(t, '\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b')) + len(regexp_extract_all(t, '\\b[0-9]{2}/[0-9]{2}/[0-9]{4}\\b')) AS BIGINT) AS dates,
  CAST(len(list_filter(regexp_split_to_array(regexp_replace(t, '(^|[^\\p{L}0-9_])(\\p{Lu}\\p{Ll}+)', '\\1\u0001\\2', 'g'), '\u0001'), lambda w: true)) - 1 AS BIGINT) AS mots FROM j""",
}
