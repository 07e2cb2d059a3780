"""Fixed values of the portal's data: labels, markers, keywords, addresses and excluded files.

These must equal the published ones for right results; nothing here is logic.
"""

# fixed values: labels of the detail page by field, in order of precedence
FIELD_ALIASES = {
    "date_limite_remise_plis": ["Date et heure limite de remise des plis", "Date limite de remise des plis", "Date limite"],
    "reference": ["Référence de la consultation", "Référence"],
    "objet": ["Objet de la consultation", "Objet"],
    "acheteur_public": ["Acheteur public", "Maître d'ouvrage"],
    "type_annonce": ["Type d'annonce"],
    "mode_passation": ["Procédure", "Mode de passation", "Type de procédure"],
    "categorie_principale": ["Catégorie principale", "Catégorie"],
    "lieu_execution": ["Lieu d'exécution"],
    "estimation_dhs_ttc": ["Estimation (en Dhs TTC)", "Estimation", "Montant estimatif"],
    "caution_provisoire": ["Caution provisoire", "Cautionnement provisoire"],
    "qualifications": ["Qualifications"],
    "domaines_activite": ["Domaines d'activité", "Domaine d'activité"],
    "allotissement": ["Allotissement"],
    "reserve_tpe_pme": ["Réservé à la TPE et PME", "Réservé"],
    "lieu_ouverture_plis": ["Lieu d'ouverture des plis"],
}
# fixed values: markers of an absent value
MISSING = ["", "-", "--", "n/a", "néant", "neant"]
# fixed values: addresses
SITE_ROOT = "https://www.marchespublics.gov.ma/"
SITE_INDEX = "https://www.marchespublics.gov.ma/index.php"
# fixed values: words that announce a table of bidders
TABLE_KEYWORDS = ["classement", "concurrent 1", "concurrent 2", "montant par", "liste des concurrents"]
# fixed values: characters that broken fonts leave in a text, as a pattern
PROBE_NOISE = r"[\[\]{}\\|]"
# fixed values: files that are left out of OCR
EXCLUDED_STEMS = ["65597f99d131db2a59fabcab9bb39929f9f1f9f1ff518a1ef60e0ccdb0bfcf78", "9d2a5e0783702e0198d5bdfe23c3212d72fa6501308724cbb85bf03d2b6d01e1"]
# fixed values: statuses of a document, in report order
STATUSES = ["native", "ocr_success", "ocr_low_confidence", "ocr_failed"]
# fixed values: order of a record's fields
RECORD_ORDER = ["reference", "objet", "acheteur_public", "type_annonce", "mode_passation", "categorie_principale", "lieu_execution", "estimation_dhs_ttc", "caution_provisoire", "qualifications", "domaines_activite", "allotissement", "reserve_tpe_pme", "date_mise_ligne", "date_limite_remise_plis", "lieu_ouverture_plis", "dossier_consultation_url", "refConsultation", "orgAcronyme", "source", "annee", "annee_source", "is_publicly_downloadable", "source_url", "scraped_at", "extras"]
# fixed values: how the client names itself
AGENT = "tender-analytics-bot (academic project)"
# fixed values: limits of the rule on corrupted text: tokens that it needs, malformed share, noise marks in 1,000 characters; least length of own text
CORRUPT_TOKENS, CORRUPT_SHARE, CORRUPT_NOISE, OWN_TEXT = 20, 0.35, 4.0, 20
# fixed values: tokens of the rule, as patterns
TOKEN, CLEAN_TOKEN = r"\S{3,}", r"^[A-Za-zÀ-ÿ]+[.,;:)]?$"
