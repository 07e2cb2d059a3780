"""Small inputs shaped like the portal's values, and SQL that builds many more from the tables."""

LINES = [
    "Référence 17/DR/2025",
    "Date et heure limite de remise des plis : 21/05/2025 10:30",
    "Objet : Fourniture de mobilier scolaire : lot unique",
    "Acheteur public : Commune d'Azrou / Service des achats",
    "Procédure : Concours | Enveloppe unique",
    "Catégorie principale : Fournitures",
    "Allotissement : Oui",
    "Lieu d'exécution : AZROU",
    "Estimation (en Dhs TTC) * : 2 450 300,50 @@@@",
    "Réservé à la TPE et PME * : Oui",
    "Domaines d'activité :",
    "Domaines d'activité : Ameublement",
    "Domaines d'activité : Bois",
    "Caution provisoire : 12.500,00 MAD",
    "Qualifications : néant",
    "Réunion d'information : 02/05/2025 , salle B",
    "sans rien",
    None,
    "Référence",
]

VALUES = ["15 000 000,00 @@@@", "133 075 758,00", "0,00 MAD", "758 640,00 DH TTC", "15.000.000", "-", "", None, "1.234.567,89", "1,234.56", "1,234,567", "15.000", "120.000,00", "2 337 480.00", "12-34", "5,00 Dhs.", "Néant", " n/a ", "** texte  double **", " NBSP ici ", "--", "-5,5", "abc", "4d", ".5", "5."]
DATES = ["04/11/2026 11:00", "12/08/2026", "32/01/2026", "pas de date", None, "29/02/2023 puis 01/03/2023", "le 29/02/2024.", "1/2/2024", "112/08/20261", "31/04/2025", ""]
BOOLS = ["Oui", "non", "-", "", None, "OUI, deux lots", "No", "Yes", "Nord", "peut-être", " * Non * "]
LABELS = ["Date limite", "Référence de la consultation", "Référence", "Objet ", "Lieu d'exécution", "Lieu d'ouverture des plis", "Lieu d’exécution", "Estimation (en Dhs TTC) *", "Montant estimatif", "CATÉGORIE principale", "Visites des lieux", "", None, "Réservé à la TPE et PME installées au Maroc *", "Mode de passation", "  Procédure   * ", "Domaine d'activité", "Cautionnement provisoire", "Qualifications"]
REFERENCES = [" aon31/2024/so2300up ", "22 / 2026 / DAAC", None, "", "--", "./AO-1/.", "é x / 3", "01/2026"]
URLS = ["?page=entreprise.EntrepriseDetailConsultation&refConsultation=1031023&orgAcronyme=l1f", "http://x/y?orgAcronyme=a%20b&refConsultation=7", "refConsultation=abc&orgAcronyme=", "/index.php?x=1", "index.php?refConsultation=12", None, "//cdn/x", "https://z/?orgAcronyme=q\"r"]
BLOBS = ["Catégorie : Travaux || Procédure : AOO | x", "Catégorie principale: Services Procédure : AOO || Acheteur public : Commune de X", "Acheteur public : A  B || Objet : Y", "Objet :   || Catégorie : Fournitures Acheteur public : Z", "rien", None]
COMPANIES = ["STE ALPHA SARL", "Société Beta", "SARL AU Gamma", "groupement Alpha et Beta", "Groupement : X / Y / Z", "delta  travaux", "STE. OMEGA S.A.R.L.", "", None, "Etablissement Et Fils"]
MINUTES = ["Concurrent retenu : STE X", "L'appel d'offres est déclaré INFRUCTUEUX", "Offre excessive", "Soumissionnaire attributaire", "Marché attribué à Y", "rien", None, "Les offres sont excessives"]
MIXED = ["ROYAUME DU MAROC المملكة المغربية", "‏abc‪ def", "texte", "", None, "١٢٣ 45"]
SIDES = [842.0, 595.0, 3507.0, 14613.0, 0.0, None, 960.0, 961.0, 1191.0]
LINKS = [(1, 1, "x/EntrepriseDemandeTelechargementDce?a"), (1, 2, "y/telechargerDce?b"), (2, 1, "x/EntrepriseDemandeTelechargementDce?c"), (2, 2, "x/EntrepriseDemandeTelechargementDce?d"), (3, 1, "/autre"), (4, 1, "?page=DCE"), (4, 2, "http://h/dce")]
COUNTS = ["Nombre de résultats : 100 541", "nombre de resultats: 12", "Nombre de résultats : 1 234 x", "aucun", None, "Nombre de résultats :   "]
PV = [
    "Extrait du PV\nSéance du 12/03/2024\nListe des concurrents ayant déposé leurs plis :\n- STE ALPHA\n- BETA SARL\n\nConcurrents écartés : Néant\n\nConcurrent retenu : Groupement ALPHA et GAMMA\nMontant : 716 971,20 puis 559 980.00",
    "Liste des concurrents ayant déposé un pli : X ; Y ; Z\n\nL'appel d'offres est déclaré INFRUCTUEUX",
    "Soumissionnaire attributaire : -\n120.000,00",
    "",
    None,
]

# the same values in both engines: SQL over the tables
PRICE = "CAST(floor(o_totalprice) AS BIGINT)"
DAY = "(lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING))"
KEY = "CAST(o_orderkey AS STRING)"
LINK = f"'?page=entreprise.EntrepriseDetailConsultation&refConsultation=' || {KEY}"
#: By list: table, key and value.
FROM_TABLES = {
    "VALUES": ("orders", "o_orderkey", f"CASE o_orderkey % 6 WHEN 0 THEN CAST({PRICE} AS STRING) || ',50 DH TTC' WHEN 1 THEN CAST({PRICE} % 1000 AS STRING) || '.000,25 MAD' WHEN 2 THEN '1 ' || lpad(CAST({PRICE} % 1000 AS STRING), 3, '0') || ' 500,00 @@@@' WHEN 3 THEN CAST({PRICE} % 900 AS STRING) || ',123.75' WHEN 4 THEN '-' ELSE '* ' || CAST({PRICE} AS STRING) || ' Dhs.' END"),
    "DATES": ("orders", "o_orderkey", f"CASE o_orderkey % 5 WHEN 0 THEN {DAY} || ' 11:00' WHEN 1 THEN 'le ' || {DAY} || '.' WHEN 2 THEN '31/' || substr({DAY}, 4, 7) WHEN 3 THEN substr({DAY}, 2, 9) ELSE 'sans date' END"),
    "BOOLS": ("orders", "o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN 'Oui, ' || o_orderpriority WHEN 1 THEN ' Non ' WHEN 2 THEN o_orderpriority WHEN 3 THEN '-' ELSE 'No ' || o_orderstatus END"),
    "LABELS": ("part", "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'Objet ' || p_name WHEN 1 THEN '  Référence *' WHEN 2 THEN p_name WHEN 3 THEN 'Catégorie ' || p_type ELSE 'Estimation ' || p_type || ' * ' END"),
    "LINES": ("part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'Objet : ' || p_name WHEN 1 THEN 'Référence ' || CAST(p_partkey AS STRING) || '/2025' WHEN 2 THEN p_name || ' : ' || p_type ELSE p_name END"),
    "REFERENCES": ("orders", "o_orderkey", f"CASE o_orderkey % 3 WHEN 0 THEN '  ao ' || {KEY} || ' / ' || o_orderstatus || '-' WHEN 1 THEN './' || o_orderpriority ELSE ' - ' END"),
    "URLS": ("orders", "o_orderkey", f"CASE o_orderkey % 3 WHEN 0 THEN {LINK} WHEN 1 THEN {LINK} || '&orgAcronyme=o' || CAST(o_custkey % 9 AS STRING) ELSE 'x?orgAcronyme=' || o_orderstatus END"),
    "BLOBS": ("part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'Catégorie : ' || p_type || ' || Acheteur public : ' || p_name WHEN 1 THEN 'Catégorie principale: ' || p_type || ' Procédure : AOO || Objet : ' || p_name ELSE p_name END"),
    "COMPANIES": ("supplier", "s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN 'STE ' || s_name || '  SARL' WHEN 1 THEN 'Groupement : ' || s_name || ' / Beta et Gamma' WHEN 2 THEN s_name ELSE 'Société ' || lower(s_name) || ' SA' END"),
    "MINUTES": ("part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'Concurrent retenu : ' || p_name WHEN 1 THEN 'Appel déclaré infructueux, ' || p_name WHEN 2 THEN 'Les offres sont excessives' ELSE p_name END"),
    "MIXED": ("documents", "doc_id", "'المملكة ' || text || ' 45'"),
    "COUNTS": ("orders", "o_orderkey", f"CASE o_orderkey % 3 WHEN 0 THEN 'Nombre de résultats : ' || {KEY} WHEN 1 THEN 'nombre de resultats: 1 ' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ' page' ELSE {KEY} END"),
    "SIDES": ("part", "p_partkey", "CAST(p_partkey * 7 % 15000 AS DOUBLE)"),
    "ANGLES": ("part", "p_partkey", "CAST(p_partkey % 201 - 100 AS DOUBLE) / 40"),
    "PV": ("orders", "o_orderkey", f"CASE o_orderkey % 3 WHEN 0 THEN 'Séance du ' || {DAY} || chr(10) || 'Liste des concurrents ayant déposé leurs plis :' || chr(10) || '- C' || CAST(o_custkey AS STRING) || chr(10) || '- BETA' || chr(10) || chr(10) || 'Concurrent retenu : C' || CAST(o_custkey AS STRING) || chr(10) || 'Montant : ' || CAST({PRICE} AS STRING) || ',20' WHEN 1 THEN 'Concurrents écartés : D' || CAST(o_custkey AS STRING) || ' ; E' || chr(10) || chr(10) || 'Appel déclaré infructueux le ' || {DAY} ELSE o_orderpriority END"),
}
#: (page, pos, href) of links.
LINKS_FROM = ("orders", "CAST(o_custkey + 100 AS BIGINT)", "CAST(o_orderkey AS INT)", f"CASE o_orderkey % 4 WHEN 0 THEN 'x/EntrepriseDemandeTelechargementDce?' || {KEY} WHEN 1 THEN '/telechargerDce?' || {KEY} WHEN 2 THEN '?page=' || o_orderstatus ELSE 'http://h/' || {KEY} END")
ANGLES = [0.4, 0.6, -3.88, 0.0, -0.5]

_REF = f"{KEY} || '/' || o_orderstatus"
_ROW = f"'<td>AOO ' || o_orderpriority || ' ' || {DAY} || '</td><td>' || {_REF} || ' - Marché &amp; lot</td><td>01/02/2031</td>'"
_HREF = f"'<a href=\"?page=entreprise.EntrepriseDetailConsultation&amp;refConsultation=' || {KEY} || '&amp;orgAcronyme=o' || CAST(o_custkey % 9 AS STRING) || '\">Voir</a>'"
#: A listing page of each order: a row, the same consultation again, and by key a row without a link, without dates, or a link outside rows.
LISTING_PAGE = f"'<html><body><table><tr>' || {_ROW} || '<td>' || {_HREF} || '</td></tr><tr><td>bis</td><td>' || {_HREF} || '</td></tr>' || CASE o_orderkey % 4 WHEN 0 THEN '<tr><td>A - B</td><td>none</td></tr>' WHEN 1 THEN '<tr><td>Sans date<td>R' || {_REF} || ' - x</td><td><a href=\"?x=EntrepriseDetailConsultation&amp;refConsultation=7&amp;orgAcronyme=z\">y</a></tr>' WHEN 2 THEN '<br></table><a href=\"EntrepriseDetailConsultation&amp;refConsultation=8&amp;orgAcronyme=z\">out</a><table>' ELSE '' END || '</table></body></html>'"
#: A detail page of each order.
DETAIL_PAGE = f"'<div class=\"line\">Référence ' || {_REF} || '</div><div class=\"a line\"><b>Objet</b> : Travaux &eacute;t&eacute; ' || {KEY} || '</div><div class=\"line\">Estimation (en Dhs TTC) * : ' || CAST({PRICE} AS STRING) || ',50 @@@@</div><div class=\"line\">Date limite : ' || {DAY} || ' 10:00</div><div class=\"line\">Procédure : ' || o_orderpriority || ' | pli</div><div>Objet : hors bloc</div>' || CASE o_orderkey % 3 WHEN 0 THEN '<div class=\"line\">Allotissement : Oui</div><a href=\"x/EntrepriseDemandeTelechargementDce?' || {KEY} || '\">d</a>' WHEN 1 THEN '<div class=\"line\">Visite : ' || {DAY} || '</div><div class=\"line\">Visite : plus tard</div><a href=\"EntrepriseDemandeTelechargementDce\">d</a><a href=\"?dce=' || {KEY} || '\">e</a>' ELSE '<div class=\"line\">Objet : second</div><div class=\"line\">Allotissement : -</div>' END"
