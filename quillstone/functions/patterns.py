"""Word lists, lookup tables, constants, patterns and formats that results depend on."""

import re

# --- retrieval ------------------------------------------------------------
RETRIEVAL_LIMIT = 20
RRF_K = 60
ENTITY_BOOST = 0.01
CHUNK_CHARS = 900

STOPWORDS = ("a", "an", "and", "at", "de", "d", "des", "does", "est", "how", "combien", "ete", "il", "is", "la", "le", "les", "quel", "quelle", "quelles", "qui", "l", "requi", "requis", "of", "on", "the", "to", "t", "what", "when", "who")

STEM_SUFFIXES = ("ments", "ment", "ing", "ed", "es", "s")

CANONICAL_TOKENS = {
    "accord": "agreement", "agree": "agreement", "contrat": "agreement", "annuel": "annual", "annuelle": "annual",
    "approbation": "approval", "autorisation": "approval", "cout": "amount", "cost": "amount", "fee": "amount", "montant": "amount",
    "effect": "effective", "effet": "effective", "heures": "deadline", "hours": "deadline", "hour": "deadline", "delai": "deadline",
    "duree": "duration", "maintient": "maintain", "flux": "feed", "mensuel": "monthly", "mensuelle": "monthly", "notify": "notification",
    "notification": "notification", "owner": "owner", "possede": "owner", "proprietaire": "owner", "preavis": "notice", "preavi": "notice",
    "renouvellement": "renewal", "renouvelle": "renewal", "renew": "renewal", "retarde": "delayed", "delay": "delayed", "retard": "delayed",
    "retention": "retention", "risque": "risk", "temps": "duration", "temp": "duration", "minutes": "duration", "minut": "duration",
    "sev": "severity", "severite": "severity", "sous": "subcontractor", "subcontractors": "subcontractor", "traitants": "subcontractor",
    "tva": "vat", "adresse": "address", "disponibilite": "availability", "penalite": "penalty", "paiement": "payment", "tribunal": "court",
    "retablissement": "restoration", "recovery": "restoration", "budget": "budget", "bitcoin": "bitcoin",
}

FIELD_TOKENS = ("amount", "annual", "approval", "deadline", "delayed", "duration", "effective", "maintain", "monthly", "notice", "notification", "owner", "renewal", "retention", "risk", "severity", "subcontractor")
GENERIC_TOKENS = (*FIELD_TOKENS, "agreement", "apply", "date", "document", "incident", "register", "report", "supplier", "vendor")

IDENTITY_LINE = (
    r"^(?:organization|organisation|supplier|fournisseur|vendor legal entity|client record supplier|soci[eé]t[eé] concern[eé]e)\b"
    r"|\b(?:ltd\.?|llc|gmbh|inc\.?)\s*$"
)

SCOPES = (
    (r"\b(?:contrat|accord|agreement)\b", "agreement"),
    (r"\b(?:rapport|report)\b", "incident"),
    (r"\b(?:registre|register)\b", "register"),
    (r"\bincident\b", "incident"),
)

# --- dates and money ------------------------------------------------------
MONTH_NAMES = (
    r"January|February|March|April|May|June|July|August|September|October|November|December|"
    r"janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"
)
MONTH_NUMBERS = {
    "january": 1, "janvier": 1, "february": 2, "fevrier": 2, "march": 3, "mars": 3, "april": 4, "avril": 4, "may": 5, "mai": 5,
    "june": 6, "juin": 6, "july": 7, "juillet": 7, "august": 8, "aout": 8, "september": 9, "septembre": 9, "october": 10, "octobre": 10,
    "november": 11, "novembre": 11, "december": 12, "decembre": 12,
}
DATE = rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:er)?\s+(?:{MONTH_NAMES})\s+\d{{4}}|(?:{MONTH_NAMES})\s+\d{{1,2}},?\s+\d{{4}})\b"
DEADLINE = r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|dix)\s+(?:minutes?|hours?|days?|heures?|jours?)\b"
AMOUNT = r"(?:\b(?:EUR|USD|GBP)\s*[$€£]?\s*[0-9][0-9 ,.]*|[$€£]\s*[0-9][0-9 ,.]*\s*(?:EUR|USD|GBP)?|\b[0-9][0-9 ,.]*\s*(?:EUR|USD|GBP|€|£|\$))\b"
MISSING_DATE = r"\b(?:not recorded|missing|unknown|not available|non renseign[eé]e?)\b"
CURRENCY_CODES = {"EUR": "EUR", "€": "EUR", "USD": "USD", "$": "USD", "GBP": "GBP", "£": "GBP"}
CURRENCY = r"(?:EUR|USD|GBP|€|\$|£)"
MONEY_NUMBER = r"(?:\d{1,3}(?:[\s\x{00a0}\x{202f}'.,]\d{3})+|\d+)(?:[.,]\d{1,2})?"

# --- personal data --------------------------------------------------------
# Letters, numbers and _ are what words are made of: a combining mark ends one, which Java's own \w and \b would count in.
_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
#: Name, pattern, placeholder, and what a text with a match holds at least: texts without are passed over quickly.
PERSONAL_DATA = (
    ("email", rf"(?iu){_EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_EDGE}", "[EMAIL REDACTED]", "@"),
    ("phone", rf"(?=[+\p{{Nd}}])(?<!{_WORD})(?:\+\p{{Nd}}{{1,3}}[ .-]?)?(?:\p{{Nd}}[ .-]?){{8,11}}\p{{Nd}}(?!{_WORD})", "[PHONE REDACTED]", r"\p{Nd}[ .-]?\p{Nd}(?:[ .-]?\p{Nd}){7}"),
    ("identifier", rf"(?iu){_EDGE}SYN-ID-[A-Z0-9-]{{4,}}{_EDGE}", "[IDENTIFIER REDACTED]", "(?iu)SYN-ID-"),
)
# The same as SQL's engine has them: words are ASCII's but beside numbers, only two letters past ASCII fold to one of its own,
# and a number takes along the characters around it: one that shares its first with another's last is found by a second pass.
_ASCII_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_FOLDS = r"A-Za-z\x{017f}\x{212a}"
#: Letters and numbers of Unicode 14 and 15, which older Java doesn't know as such.
_NEWER = (
    r"\x{0870}-\x{0887}\x{0889}-\x{088e}\x{08b5}\x{08c8}-\x{08c9}\x{0c5d}\x{0cdd}\x{170d}\x{171f}\x{1b4c}\x{2c2f}\x{2c5f}\x{9ffd}-\x{9fff}\x{a7c0}-\x{a7c1}"
    r"\x{a7d0}-\x{a7d1}\x{a7d3}\x{a7d5}-\x{a7d9}\x{a7f2}-\x{a7f4}\x{10570}-\x{1057a}\x{1057c}-\x{1058a}\x{1058c}-\x{10592}\x{10594}-\x{10595}"
    r"\x{10597}-\x{105a1}\x{105a3}-\x{105b1}\x{105b3}-\x{105b9}\x{105bb}-\x{105bc}\x{10780}-\x{10785}\x{10787}-\x{107b0}\x{107b2}-\x{107ba}"
    r"\x{10f70}-\x{10f81}\x{11071}-\x{11072}\x{11075}\x{1123f}-\x{11240}\x{11740}-\x{11746}\x{11ab0}-\x{11abf}\x{11f02}\x{11f04}-\x{11f10}"
    r"\x{11f12}-\x{11f33}\x{11f50}-\x{11f59}\x{12f90}-\x{12ff0}\x{1342f}\x{13441}-\x{13446}\x{16a70}-\x{16abe}\x{16ac0}-\x{16ac9}\x{1aff0}-\x{1aff3}"
    r"\x{1aff5}-\x{1affb}\x{1affd}-\x{1affe}\x{1b11f}-\x{1b122}\x{1b132}\x{1b155}\x{1d2c0}-\x{1d2d3}\x{1df00}-\x{1df1e}\x{1df25}-\x{1df2a}"
    r"\x{1e030}-\x{1e06d}\x{1e290}-\x{1e2ad}\x{1e4d0}-\x{1e4eb}\x{1e4f0}-\x{1e4f9}\x{1e7e0}-\x{1e7e6}\x{1e7e8}-\x{1e7eb}\x{1e7ed}-\x{1e7ee}"
    r"\x{1e7f0}-\x{1e7fe}\x{2a6de}-\x{2a6df}\x{2b735}-\x{2b739}\x{31350}-\x{323af}"
)
_SQL_OTHER = rf"[^\p{{L}}\p{{N}}_{_NEWER}]"
_SQL_PHONE = ("phone", rf"(^|{_SQL_OTHER})((?:\+[0-9]{{1,3}}[ .-]?)?(?:[0-9][ .-]?){{8,11}}[0-9])(\z|{_SQL_OTHER})", "$1[PHONE REDACTED]$3", r"[0-9][ .-]?[0-9](?:[ .-]?[0-9]){7}")
SQL_PERSONAL_DATA = (
    ("email", rf"{_ASCII_EDGE}[{_FOLDS}0-9._%+-]+@[{_FOLDS}0-9.-]+\.[{_FOLDS}]{{2,}}{_ASCII_EDGE}", "[EMAIL REDACTED]", "@"),
    _SQL_PHONE,
    _SQL_PHONE,
    ("identifier", rf"{_ASCII_EDGE}[Ss\x{{017f}}][Yy][Nn]-[Ii][Dd]-[{_FOLDS}0-9-]{{4,}}{_ASCII_EDGE}", "[IDENTIFIER REDACTED]", r"[Yy][Nn]-[Ii][Dd]-"),
)

# --- questions (on folded text) -------------------------------------------
INTENTS = (
    ("renewal_date", (r"\b(?:renew|renewal|renouvel|recondu|echeance)\w*\b",)),
    ("effective_date", (r"\b(?:effective|effect|effet|commence|commencement|starts?|application|vigueur)\w*\b",)),
    ("notification_deadline", (r"\b(?:notification|notify|notifier)\w*\b", r"\b(?:deadline|delai|quickly|hours?|heures?|days?|jours?)\b")),
    ("duration", (r"\b(?:duration|duree|how long|combien de temps|delayed|retard)\b",)),
    ("document_type", (r"\b(?:document type|document kind|type de document|nature|categorie)\b",)),
    ("important_amounts", (r"\b(?:amount|fee|cost|price|budget|charge|rate|cout|montant|prix|forfait)\b",)),
    ("responsible_people", (r"\b(?:responsible|manager|owner|accountable|contact|responsable|qui est le pilote)\b",)),
    ("risks", (r"\b(?:risk|risque|exposure|control gap)\b",)),
    ("organization_name", (r"\b(?:organization|organisation|legal entity|supplier organization|supplier is named|societe|nom du fournisseur)\b",)),
    ("obligations", (r"\b(?:obligation|must|shall|required|undertakes?|doit|s engage|what .* do)\b",)),
    ("severity", (r"\b(?:severity|severite|sev[- ]?\d)\b",)),
)
SINGULAR_INTENTS = ("organization_name", "document_type", "effective_date", "renewal_date", "important_amounts", "responsible_people", "notification_deadline", "duration", "severity")
ADVERSARIAL = (
    r"\b(?:ignore|ignorez|disregard|override)\b",
    r"\b(?:invent|plausible|from memory|even if absent)\b",
    r"\b(?:administrator|admin|password|system prompt|hidden prompt)\b",
    r"\b(?:reveal|revele|expose)\b.*\b(?:secret|phone|telephone|email|prompt)\b",
)
BROAD_SCOPE = r"\b(?:across|all (?:supplier )?files|corpus|without naming|which supplier)\b"

# --- evidence (on folded segments) ----------------------------------------
RENEWAL_EVIDENCE = r"\b(?:renew|renewal|renouvel|recondu|echeance)\w*\b"
EFFECTIVE_EVIDENCE = r"\b(?:effective|takes? effect|effective from|commence|commencement|starts?|application|vigueur|prise d[' ]effet)\w*\b"
NOT_EFFECTIVE_EVIDENCE = r"\b(?:renew|renouvel|recondu)\w*\b"
NOTIFICATION_EVIDENCE = r"\b(?:notify|notification|notifier)\w*\b"
DURATION_EVIDENCE = r"\b(?:delay|delayed|duration|duree|retard|lasted)\w*\b"
TYPE_LABEL = r"^(?:document type|document kind|category|categorie|nature du document|type de piece)\s*[:—-]"
TYPE_WORD = r"\b(?:agreement|contract|addendum|schedule|statement of work|order form|accord|contrat|bon de commande|declaration de travaux|licence)\b"
RESPONSIBLE_LABEL = r"^(?:responsible manager|responsible contact|service owner|owner|accountable lead|contact operationnel|responsable(?: du compte)?)\b"
RISK_EVIDENCE = r"^(?:risk|risque|risk note|exposure note)\s*[:—-]|\bcontrol gap\b|\b(?:may|might|could|peut|peuvent)\b"
ORGANIZATION_EVIDENCE = r"^(?:organization|organisation|supplier|fournisseur|vendor legal entity|client record supplier|societe concernee)\b|\b(?:ltd\.?|llc|gmbh|inc\.?)$"
OBLIGATION_EVIDENCE = r"\b(?:shall|must|is required to|undertakes? to|doit|s[' ]engage a|est tenu de)\b|^no\s+.+\bmay\b"
SEVERITY_EVIDENCE = r"\b(?:severity|severite|sev[- ]?\d)\b"

ANSWERS = {
    "refused": "Request refused: document instructions are untrusted and redacted data cannot be recovered.",
    "insufficient": "Insufficient evidence in the selected dossier.",
    "no_renewal": "No reliable renewal date is recorded in the selected evidence.",
    "conflict": "Conflicting evidence was found; review the cited passages.",
}

# --- trust boundary (on strongly folded text) -----------------------------
HOMOGLYPHS = {
    0x0430: "a", 0x0435: "e", 0x0456: "i", 0x0458: "j", 0x043A: "k", 0x043C: "m", 0x043D: "h", 0x043E: "o", 0x0440: "p",
    0x0441: "c", 0x0442: "t", 0x0443: "y", 0x0445: "x", 0x03B1: "a", 0x03B2: "b", 0x03B5: "e", 0x03B6: "z", 0x03B7: "h",
    0x03B9: "i", 0x03BA: "k", 0x03BC: "m", 0x03BD: "n", 0x03BF: "o", 0x03C1: "p", 0x03C4: "t", 0x03C5: "y", 0x03C7: "x",
}
_OBLIGED = (
    r"\b(?:must|shall|should|has to|is required to|is instructed to|is obliged to|is directed to|is told to|doit|devra|est tenu de|est tenu d|"
    r"est requis de|est requis d|est oblige de|est oblige d|a pour instruction de|a pour instruction d)\b"
)
_OUTPUT_VERB = (
    r"\b(?:answer|respond|reply|return|set|output|state|say|use|treat|consider|provide|give|emit|produce|write|print|display|report|indicate|"
    r"repond|retourne|renvoie|affich|declare|utilis|trait|consider|fourn|ecri|imprim|indiqu)\w*\b"
)
_DISCLOSE = r"(?:reveal|disclose|divulge|divulguez|affiche|affichez|show|print|expose|dump|send|transmit|transfer|export|exfiltrate|exfiltrer|envoyer|transmettre)\w*"
_SENSITIVE = (
    r"(?:system prompt|prompt systeme|secret|token|jeton|api key|cle api|password|mot de passe|credential|identifiant|private data|donnees privees|"
    r"pii|phone|telephone|email|e-mail|keys?|cles?)"
)
_TARGETS = r"assistant|chatbot|llm|tool|outil|ai assistant|ai agent|ai model|agent ia|modele ia|robot|bot|language model|modele de langage|artificial intelligence|intelligence artificielle"
UNTRUSTED = (
    r"\b(?:non fiable|untrusted|do not trust|prompt injection|malicious sample|instruction inseree|message destine (?:au robot|a l'assistant)|texte d'essai)\b",
    r"\b(?:ignore|ignorez|disregard|forget|oubliez|override|bypass|contournez?)\b.{0,120}\b(?:previous|prior|precedent(?:e|es|s)?|system|developer|user|utilisateur|question|instruction|rule|regle|policy|politique|consigne)\w*\b",
    r"\b(?:(?:fake|false|faux|fausse)\s+)?(?:system|developer|administrator|administrateur|admin)\s+(?:message|instruction|directive|order|ordre|override)\b",
    r"\b(?:security team|equipe (?:de )?securite|system|developer|administrator|administrateur|admin)\s+(?:override|instruction|directive|order|ordre|message)\b.{0,140}\b(?:answer|respond|return|set|repond|retourne|forward|transfer|transmit|send|disclose|reveal|grant|approve|envoyer|transmettre|divulguer)\w*\b",
    r"\b(?:expected (?:result|answer)|resultat attendu|reponse attendue)\b.{0,120}\b(?:always|toujours|answer|respond|return|repond|retourne|regardless|quel que soit)\w*\b",
    r"\b(?:answer|respond|return|set the answer to|reponds?|retourne)\b.{0,100}\b(?:regardless of evidence|without evidence|even if absent|sans preuve|malgre les preuves|access[- ]granted|approved)\b",
    r"\b(?:override|bypass|contournez?)\b.{0,80}\b(?:answer|respond|return|set|repond|retourne)\w*\b",
    r"^(?:please\s+)?(?:(?:answer|respond|reponds?)\w*\b.{0,80}\b(?:question|query|answer|response|result|date|amount|code|reponse|resultat|montant)\b|(?:return|set|retourne)\w*\b.{0,120}\b(?:as|comme)\b.{0,40}\b(?:answer|response|result|date|amount|code|reponse|resultat|montant)\b)",
    rf"\b(?:{_TARGETS})\b.{{0,60}}"
    + _OBLIGED + r".{0,100}" + _OUTPUT_VERB
    + r"(?:.{0,120}\b(?:exactly|only|always|toujours|uniquement)\b|.{0,120}\b(?:with|as|comme)\b.{0,80}\b(?:answer|response|result|date|amount|code|question|query|reponse|resultat|montant|renouvellement)\b|.{0,120}\b(?:approved|access granted)\b)",
    r"\bsyst(?:em|eme)\b.{0,60}" + _OBLIGED + r".{0,100}" + _OUTPUT_VERB
    + r".{0,120}\b(?:with|as|comme|exactly|only|always|toujours|uniquement)\b.{0,80}\b(?:answer|response|result|date|amount|code|question|query|approved|access granted|reponse|resultat|montant|renouvellement)\b",
)
DISCLOSURE = rf"\b{_DISCLOSE}\b.{{0,140}}\b{_SENSITIVE}\b|\b{_SENSITIVE}\b.{{0,140}}\b{_DISCLOSE}\b"
PROHIBITION = rf"\b(?:must not|shall not|do not|never|is prohibited from|ne doit pas|interdit de)\b.{{0,80}}\b{_DISCLOSE}\b"

# Beginnings of words of which every pattern above needs one.
_TRIGGERS = (
    "non fiable|untrusted|do not trust|prompt|malicious|instruction|message|texte|ignore|disregard|forget|oubliez|override|bypass|contourne|system|developer|admin|security team|equipe|"
    "expected|resultat|reponse|answer|respond|repond|return|set|retourne|assistant|chatbot|llm|tool|outil|ai |agent|modele|robot|bot|language|artificial|intelligence"
)


def untrusted(product: str | None = None) -> tuple[str, ...]:
    """The patterns; a system's own name (one or more words) is a target of instructions like `assistant`."""
    if not product:
        return UNTRUSTED
    name = " ".join(re.findall("[a-z0-9]+", product.lower()))
    return tuple(p.replace(f"(?:{_TARGETS})", f"(?:{_TARGETS}|{name})") for p in UNTRUSTED)


def trigger(product: str | None = None) -> str:
    name = "|" + " ".join(re.findall("[a-z0-9]+", product.lower())) if product else ""
    return f"{_TRIGGERS}|{_DISCLOSE}|{_SENSITIVE}{name}"


# --- roles ----------------------------------------------------------------
ROLE_ACTIONS = {
    "admin": ("view_document", "upload_document", "delete_document", "ask_question", "view_extraction", "run_evaluation", "view_audit"),
    "analyst": ("view_document", "upload_document", "ask_question", "view_extraction"),
    "reader": ("view_document", "ask_question", "view_extraction"),
}

# --- evaluation targets ---------------------------------------------------
TARGET_MINIMA = {"citation_precision": 0.90, "citation_recall": 0.90, "citation_case_accuracy": 0.90, "abstention_accuracy": 0.85, "extraction_f1": 0.90}
TARGET_ZEROS = ("error_rate", "schema_error_rate")

# --- field extraction -----------------------------------------------------
EXTRACT_DATE = rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{1,2}}(?:er)?\s+(?:{MONTH_NAMES})\s+\d{{4}}|(?:{MONTH_NAMES})\s+\d{{1,2}},?\s+\d{{4}})\b"
EXTRACT_AMOUNT = r"(?:\b(?:EUR|USD|GBP)\s+[$€£]?\s*[0-9][0-9 ,.]*[0-9]|[$€£]\s*[0-9][0-9 ,.]*[0-9](?:\s+(?:EUR|USD|GBP))?|\b[0-9][0-9 ,.]*[0-9]\s+(?:EUR|USD|GBP|€|£|\$))"
LEGAL_ENTITY = r"\b[^\n:—]+?\s+(?:Ltd\.?|LLC|GmbH|Inc\.?)\s*$"
DOCUMENT_TITLE = r"\b(?:agreement|contract|addendum|schedule|statement of work|order form|licence|accord|contrat|bon de commande|déclaration de travaux)\b"
OBLIGATION = r"(?:\bshall\b|\bmust\b|\bis required to\b|\bundertakes? to\b|\bdoit\b|\bs'engage à\b|\best tenu de\b|^No\s+.+\bmay\b)"
NEGATED_OBLIGATION = (
    r"\b(?:must|shall|will|do|does|did|is|are|was|were)\s+not\b|\bnot\s+(?:required|obligated|bound)\b|\bn(?:’|')?est\s+pas\s+tenu\b|"
    r"\bne\s+(?:doit|doivent|devra|devront|peut|peuvent|pourra|pourront)\s+pas\b|\bne\s+\w+\s+pas\s+(?:doit|est\s+tenu)\b"
)
IMPLIED_RISK = (r"(?iu)\bcontrol gap\b", r"\b(?:may|might|could)\b", r"(?iu)\b(?:peut|peuvent)\b")
LABELS = {
    "organization_name": ("Organization", "Organisation", "Supplier", "Fournisseur", "Vendor legal entity", "Client record supplier", "Société concernée", "Fournisseur / Organization"),
    "document_type": ("Document type", "Document kind", "Category", "Catégorie", "Nature du document", "Type de pièce"),
    "effective_date": ("Effective date", "Effective from", "Commencement", "Date d'application", "Prise d'effet", "Entrée en vigueur"),
    "renewal_date": ("Renewal date", "Renouvellement", "Prochaine échéance de renouvellement"),
    "obligations": ("Obligation", "Engagement"),
    "responsible_people": ("Responsible manager", "Responsible contact", "Service owner", "Owner", "Accountable lead", "Contact opérationnel", "Responsable", "Responsable du compte", "Owner / Responsable"),
    "risks": ("Risk", "Risque", "Risk note", "Exposure note"),
}
EFFECTIVE_CONTEXT = r"\b(?:takes? effect|commences?|effective from|entre en vigueur|vigueur)\b"
RENEWAL_CONTEXT = r"\b(?:renewal|renews?|reconduit|renouvellement)\b"
FIELDS = ("organization_name", "document_type", "effective_date", "renewal_date", "important_amounts", "obligations", "responsible_people", "risks")
FIELD_KINDS = {"effective_date": "date", "renewal_date": "date", "important_amounts": "money"}

# --- field extraction from prose ------------------------------------------
PROSE_DATE = rf"\b(?:\d{{4}}[-.]\d{{2}}[-.]\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|(?:\d{{1,2}}(?:er)?|premier)\s+(?:{MONTH_NAMES})\s+\d{{4}}|(?:{MONTH_NAMES})\s+\d{{1,2}},?\s+\d{{4}})\b"
PROSE_AMOUNT = (
    r"(?:\b(?:EUR|USD|GBP)\s*[$€£]?\s*\d[\d ,.]*\d(?:[.,]\d+)?k?\b|[$€£]\s*\d[\d ,.]*\d(?:[.,]\d+)?k?(?:\s*(?:EUR|USD|GBP))?\b|"
    r"\b\d[\d ,.]*\d(?:[.,]\d+)?k?\s*(?:EUR|USD|GBP|€|£|\$)(?=$|[^\w])|"
    r"\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|"
    r"thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?\s+thousand\s+(?:pounds?|euros?|dollars?)\b)"
)
PERSON = r"\b([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+(?:\s+[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+){1,2})\b"
ROLE_VERBS = r"\b(?:coordinates?|owns?|leads?|led|maintains?|maintained|handles?|approves?|investigates?|validates?|arbitre|anime|coordonne|pilote|suit|valide|tient|autorise|responsable|stewards?)\b"
ROLE_NOUNS = r"\b(?:stewards?|responsables?)\b"
OBLIGATION_VERBS = (
    r"\b(?:keep|keeps|preserve|preserves|archives|archived|distribute|distributes|circulate|circulates|send|sends|reopen|reopens|photograph|photographs|"
    r"transmit|transmits|conserve|conservent|informe|informent|adresse|adressent|photographie|photographient|photographions|transmet|transmettent|entretient|entretiennent)\b"
)
RISK_WORDS = r"\b(?:risk|risque|single|lone|unique|absence|dependenc|dépend|could|might|may|peut|pourrait|delay|retard|disable|isolate|interrompre|affect)\w*\b"
KIND_WORDS = r"\b(?:agreement|contract|note|file|plan|chronicle|catalogue|playbook|letter|schedule|report|accord|contrat|dossier|lettre|compte rendu)\b"
PROSE_LABELS = {
    "organization_name": ("Organization", "Organisation", "Supplier", "Fournisseur", "Vendor legal entity", "Account holder", "Plan owner organization", "Operational beneficiary"),
    "document_type": ("Document type", "Document kind", "Category", "Catégorie", "Nature du document"),
    "responsible_people": ("Responsible manager", "Responsible contact", "Service owner", "Owner", "Accountable lead", "Contact opérationnel", "Responsable", "Responsable du compte"),
}
PROSE_ORGANIZATION = (
    r"(?:operator named for .+?|custodian covered .+?|beneficiary operationnel|bénéficiaire opérationnel)\s+(?:is|est)\s+([^.;]+)",
    r"\b(?:dossier concerne|issued by)\s+([^.;]+?)(?=\s+(?:et non|for)\b|[.;])",
    r"\bconfirme que\s+([^,.;]+?)\s+(?:porte|gère|gere)\b",
    r"\b(?:account holder|plan owner organization)\s*(?:—|:)\s*([^.;]+)",
)
PROSE_EFFECTIVE = r"\b(?:begin|begins|start|starts|takes? effect|went live|activation|applicable|custody passes|prendre effet|prendra effet|devient applicable|ouvre la période|ouvre la periode|changent? de garde)\b"
PROSE_RENEWAL = r"\b(?:next .+ review|annual review|reviewed again|anniversary|annual reset|renew\w*|revue annuelle|examen annuel|prochain état|prochain etat)\b"
CLAUSE_OPENING = r"^(?:during|after|before|at|à)\b[^,]*,\s*"
CLAUSE_RELATIVE = r"^.+?\bqui\s+"
CLAUSE_JOINT = r"\s+(?:and|et)\s+"
TITLE_JOINT = r"\s+[—/]\s+"

# --- grounded answers: words ----------------------------------------------
QUESTION_NOISE = ("a", "an", "are", "account", "arrangement", "catalogue", "chronicle", "covered", "dossier", "does", "do", "did", "document", "for", "has", "have", "how", "is", "it", "file", "of", "on", "plan", "quelle", "quelles", "this", "under", "was", "what", "when", "which", "whose", "with", "du", "chez", "par", "hors", "sauf", "and", "or", "also")
CAPITAL_NOISE = ("a", "an", "can", "de", "does", "how", "if", "is", "le", "la", "on", "the", "was", "what", "when", "which", "whose", "who", "where", "combien", "why", "may", "might", "will", "would", "qui", "quand", "comment", "pourquoi", "ou", "les", "un", "master", "services", "service", "incident", "data", "processing", "personal", "security", "review", "platform", "une", "des", "du", "au", "aux", "quel", "quelle", "quels", "quelles")
DOCUMENT_TERMS = {"agreement": ("agreement", "contract", "contrat"), "addendum": ("addendum", "annex", "amendment"), "report": ("report",), "register": ("register",)}
RELATION_CLASSES = {
    "reserve": ("reserve", "reserves", "fund", "funds", "fond", "fonds", "pool"),
    "maintenance": ("maintenance", "entretien"),
    "coverage": ("coverage", "cover", "couverture"),
    "precedence": ("control", "controls", "govern", "governs", "prevail", "prevails", "precedence", "priority", "replace", "replaces", "supersede", "supersedes"),
    "amend": ("amend", "amends", "amended", "amendment", "change", "changes", "changed", "modify", "modifies", "modified", "alter", "alters", "altered"),
    "access": ("access", "accesses", "accessed", "accessing", "acces"),
    "storage": ("storage", "stockage", "archivage", "archiving"),
    "restoration": ("restore", "restores", "restored", "restoration", "recovery", "recover", "retablissement"),
    "monthly": ("monthly", "month", "months", "mois", "mensuel", "mensuelle", "mensuels", "mensuelles"),
}
MONEY_TERMS = ("fee", "fees", "budget", "budgets", "tariff", "tariffs")
KIND_NOISE = {
    "date": ("date", "effective", "deadline"),
    "amount": ("amount", "cost", "price", "prix", "how", "much", "apply", "charg", "constitue", "combien", "coute", "cout", "par", "hors", "sauf"),
    "duration": ("duration", "deadline", "period", "long", "soon", "quickly", "many"),
    "status": ("status", "statut", "recorded", "record", "consigne"),
    "severity": ("severity",),
    "responsible_people": ("owner",),
    "boolean": ("is", "are", "was", "were", "does", "do", "did", "can", "could", "may", "might", "will", "would", "has", "have"),
}
RELATION_NOISE = ("master", "servic", "service", "incident", "signed", "sign")
KIND_FIELDS = {"boolean": "answer", "date": "date", "amount": "important_amounts", "duration": "duration", "severity": "severity", "responsible_people": "responsible_people", "organization_name": "organization_name", "status": "status", "text": "answer"}
CONFLICTING_KINDS = ("boolean", "date", "amount", "duration", "severity")
LINK_TERMS = (
    ("purchase order", ("purchase order", "bon de commande", "commande")), ("shipment", ("shipment", "shipping", "expedition", "livraison")), ("dispatch", ("dispatch", "envoi")),
    ("consignment", ("consignment",)), ("contract", ("contract", "contrat")), ("agreement", ("agreement", "accord")), ("invoice", ("invoice", "facture")), ("case", ("case", "dossier")),
    ("claim", ("claim", "reclamation")), ("batch", ("batch", "lot")), ("container", ("container", "conteneur")), ("order", ("order", "commande")),
)

# --- grounded answers: patterns -------------------------------------------
GROUNDED_AMOUNT = (
    r"(?:\b(?:EUR|USD|GBP)\s*[$€£]?\s*\d[\d ,.]*\d(?:[.,]\d+)?k?(?=$|[^\w])|[$€£]\s*\d[\d ,.]*\d(?:[.,]\d+)?k?(?:\s*(?:EUR|USD|GBP))?(?=$|[^\w])|"
    r"\b\d[\d ,.]*\d(?:[.,]\d+)?k?\s*(?:EUR|USD|GBP|€|£|\$)(?=$|[^\w])|"
    r"\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|"
    r"thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?\s+thousand\s+(?:pounds?|euros?|dollars?)\b)"
)
SEVERITY = r"\b(?:SEV[- ]?\d+|severity\s+[a-z]+|sévérité\s+[a-z0-9-]+)\b"
ABSENCE = (
    r"\b(?:not\s+(?:provided|recorded|listed|available|specified|stated|supplied)|(?:unavailable|absent|missing|indisponible|absent|manquant)\b|"
    r"no\s+(?:date|amount|value|number|record|entry)\s+(?:is\s+)?(?:provided|recorded|listed)|unknown|unrecorded|n/?a|none|"
    r"non\s+(?:renseigne|enregistre|indique|consigne|consign(?:ée|é|ee))|aucun\s+(?:enregistrement|montant|numero|date))\b"
)
NEGATION = r"\b(?:no|not|never|without|cannot|can't|mustn't|non|pas|jamais|aucun)\b"
NEGATED_RELATION = r"\b(?:not|never|no|without|cannot|can't|mustn't|pas|jamais|aucun)\b"
PREDICATE = (
    r"\b(?:am|is|are|was|were|be|been|being|has|have|had|do|does|did|can|could|may|might|must|shall|should|will|would|est|sont|etaient|sera|seront|a|ont|peut|peuvent|doit|doivent|"
    r"included|provided|recorded|listed|available|specified|stated|supplied|covered|eligible|approved|authorized|allowed|required|applies|applied|inclus|incluse|incluses|fourni|fournie|"
    r"enregistre|enregistree|consigne|consignee|disponible|couvert|couverte|autorise|autorisee|requis|requise)\b"
)
COORDINATION = r"\b(?:and|et|but|mais|however|cependant)\b"
COORDINATED_FACT = r"\b(?:and|et|mais|but)\s+(?=(?:is|are|was|were|has|have|does|do|est|sont|a|ont|constitue|represents|costs)\b)"
EXCLUSION = r"\b(?:except|excluding|other than|hors|sauf)\b(.*)$"
SLOTS = r"\b(?:who|which\s+(?:person|employee|time|date|amount)|whose|when|where|what\s+(?:time|date|amount|status)|how\s+(?:much|many|long|soon))\b"
YES_NO = r"\s*(?:is|are|was|were|does|do|did|can|could|may|might|will|would|has|have|est-ce\s+que)\b"
ALTERNATIVE = r"\b(?:or|ou)\b.*\b(?:\d|minutes?|hours?|days?|heures?|jours?|eur|usd|gbp)\b"
QUESTION_KINDS = (
    ("duration", r"\b(?:how\s+much\s+time|how\s+long|how\s+quickly|how\s+soon|how\s+many\s+(?:minutes?|hours?|days?)|duration|duree|notice\s+period|notification\s+period|combien\s+de\s+temps|delai(?:\s+de\s+notification)?|deadline|periode\s+de\s+preavis)\b"),
    ("date", r"\b(?:when|quand|date|milestone|effect|applicable|commence|start|ouvre)\b"),
    ("amount", r"\b(?:how much|amount|budget|cost|charge|fee|tariff|price|prix|montant|fonds|reserve|enveloppe|combien\s+(?:coute|cout|est|facture))\b"),
    ("severity", r"\b(?:severity|severite|sev)\b"),
    ("organization_name", r"\b(?:organization|organisation|entity|entite|supplier|custodian|mutuelle|beneficiary|beneficiaire|account holder|operator|issued)\b|whose account"),
    ("responsible_people", r"\b(?:who|qui|whose)\b"),
)
STATUS_QUESTION = (r"\b(?:status|statut)\b", r"\b(?:date|renewal|renouvellement|value|champ|field)\b")
UNSAFE_QUESTION = (r"\b(?:ignore|ignorez|disregard|invent|revele|reveal|contourne|recupere|override)\b", r"\b(?:source\w*|citation\w*|controle\w*|coordonne\w*|masked|masqu\w*|system|prompt|code)\b")
PAST_EVENT = (r"\b(?:on\s+what\s+date|when|a\s+quelle\s+date)\b", r"\b(?:did|has|was|a-t-il|a-t-elle)\b", r"\b(?:notify|notifie|send|sent|occur|happen|report|declare)\w*\b")
RENEWAL_ROLE = r"\b(?:renew|renewal|renouvel|recondu|echeance)\w*\b"
EFFECTIVE_ROLE = r"\b(?:effective|takes? effect|effective from|became effective|commence(?:ment)?|starts?|application|vigueur|prise d[' ]?effet|prend\w*(?:-t-(?:il|elle)|-il|-elle)?\s+effet|prendre\s+effet|date d[' ]?effet|date effet)\w*\b"
CLOCK = r"\b(?:at|a|à)\s*(\d{1,2}:\d{2}(?:\s*[ap]\.?m\.?)?)"
EVENTS = (
    ("personal_data_breach", r"\bpersonal(?:[-\s]+data)?[-\s]+breach\b"), ("service_interruption", r"\b(?:service\s+)?(?:interruption|outage|disruption)\b"),
    ("restoration", r"\b(?:restoration|recovery)\b"), ("incident", r"\b(?:confirmed\s+)?incident\b"), ("cybersecurity_incident", r"\b(?:cybersecurity|cyber)\s+(?:security\s+)?incident\b"),
)
RELATION_CATEGORIES = {"operate": r"\boperat\w*\b", "issue": r"\b(?:issu\w*|emis\w*)\b", "concern": r"\bconcern\w*\b", "account": r"\b(?:account|holder)\b", "custody": r"\bcustod\w*\b", "owner": r"\b(?:own\w*|porte)\b", "beneficiary": r"\bbenefici\w*\b", "mutual": r"\bmutu\w*\b"}
ORGANIZATION_WORDS = r"\b(?:organization|organisation|entity|entite|name|nom)\b"
_NAME = r"([A-ZÀ-ÖØ-Þ][\wÀ-ÖØ-öø-ÿ'’-]+(?:\s+[A-ZÀ-ÖØ-Þ][\wÀ-ÖØ-öø-ÿ'’-]+){1,4})"
NAMED_ORGANIZATION = (
    rf"(?i:\b(?:issued by|émis par|emis par))\s+{_NAME}", rf"(?i:\b(?:dossier concerne))\s+{_NAME}", rf"(?i:\bconfirme que)\s+{_NAME}(?i:\s+(?:porte|gère|gere)\b)",
    rf"(?i:\b(?:holder|custodian|operator|organisation|organization|entité|entity|beneficiary|bénéficiaire)[^.;]{{0,60}}?(?:—|:|\bis\b|\best\b))\s+{_NAME}",
)
SUBJECT = r"\b[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ']*(?:-[A-Za-z0-9]+)*\b"
SUBJECT_ID = r"[a-z]{1,8}-\d+[a-z0-9-]*"
TYPED_LINK = r"\b(shipment|dispatch|consignment|purchase\s+order|order|contract|agreement|invoice|case|claim|batch|lot|container)\s+(?:(?:reference|ref|id|number|no)\s*[:#]?\s*)?([a-z]{1,8}[-/]\d+[a-z0-9/-]*)\b"
TYPE_OF_FIELD = r"\s+(?:renewal|effective|start|end|expiry)\s+(?:date|day|term)\b"
TYPE_AFTER_RENEWAL = r"\b(?:date|status|statut)\b.{0,32}\b(?:renewal|renouvellement)\b.{0,12}$"
TYPE_SOURCE_CUE = r"\b(?:in|under|from|within|of)\s+(?:the\s+)?$"
TYPE_CHANGES = r"\b(?:report|register|agreement|contract|addendum|annex)\b.{0,50}\b(?:amend|amends|amended|change|changes|changed|modify|modifies|alter|alters)\b"
FILE_TYPES = (("addendum", r"(?:^|[_\W])(?:addendum|annex|amendment|dpa)(?:$|[_\W])"), ("agreement", r"(?:^|[_\W])(?:agreement|contract|contrat|msa)(?:$|[_\W])"), ("register", r"(?:^|[_\W])register(?:$|[_\W])"), ("report", r"(?:^|[_\W])report(?:$|[_\W])"))
TITLE_TYPES = (("addendum", ("addendum", "annex")), ("agreement", ("agreement", "contract", "contrat")), ("register", ("register",)), ("report", ("report",)))

SUPPORT_WEIGHTS = {"lexical": 0.30, "semantic": 0.20, "value": 0.35, "relation": 0.15}
SUPPORT_AT = 0.48
PARTIAL_AT = 0.38
ASSESSMENT_REASONS = {
    "below": "The passage's evidence stays below the threshold of support.",
    "no_value": "The passage speaks of the relation but gives no value for it.",
    "nothing": "The passage holds no evidence that suffices.",
}
GROUNDED_ANSWERS = {
    "refused": "Request refused: document instructions are untrusted.",
    "insufficient": "Insufficient evidence in the selected dossier.",
    "multi_slot": "The question asks for multiple facts that this answer mode cannot verify together.",
    "partial": "The retrieved evidence does not state the requested value.",
    "conflict": "Conflicting values are supported; review the cited passages.",
}
GROUNDED_REASONS = {"partial": "The evidence identifies the event but not the requested value.", "conflict": "Conflicting values are supported by comparable evidence."}

# --- views, records and prompts (fixed names) -----------------------------
VIEWS = {
    "user": ("id", "username", "role"),
    "token": ("access_token", "token_type", "expires_in", "user"),
    "dossier": ("id", "name", "description", "is_synthetic"),
    "document": ("id", "dossier_id", "filename", "media_type", "status", "task_id", "correlation_id", "error_code", "created_at", "completed_at"),
    "audit_event": ("id", "actor_id", "action", "document_id", "result", "correlation_id", "metadata_safe", "created_at"),
    "question": ("question",),
    "citation": ("chunk_id", "document_id", "document_name", "page", "section", "excerpt"),
    "assessment": ("answerable", "answer", "confidence", "supporting_document", "supporting_page", "supporting_excerpt", "ambiguity_reason", "extracted_fields", "supporting_chunk_id"),
    "answer": ("status", "answer", "confidence", "mode", "citations", "correlation_id", "answerable", "supporting_document", "supporting_page", "supporting_excerpt", "ambiguity_reason", "extracted_fields", "candidate_assessments"),
    "content": ("id", "page", "section", "ordinal", "text"),
    "extraction": ("document_id", "document_name", "schema_version", "payload"),
    "evaluation_request": ("split",),
    "evaluation_run": ("id", "dataset_version", "parameters_version", "split", "mode", "metrics", "verdict", "created_at"),
}
RUN_COLUMNS = ("schema_version", "created_at", "dataset_version", "parameters_version", "seed", "split", "mode", "verdict", "cases", "extractions", "extraction_evaluation")
PROMPT_TYPE = "evidence_user_request"
PROMPT_CONTRACT = ("exact_excerpt_required", "document_and_page_required", "strict_json_required", "abstain_without_admitted_evidence")
