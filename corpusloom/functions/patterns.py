"""Word lists, patterns and labels that decide results.

Java regular expressions. ``(?U)`` gives ``\\s \\d \\w \\b`` their Unicode
meaning, ``(?iu)`` folds accented letters, ``(?d)`` makes ``\\n`` the only line end.
"""

# Stopwords of the lexical index.
STOPWORDS = (
    "a o e de da do das dos em no na nos nas um uma uns umas para por com sem "
    "que se ao aos as os ou como mais menos ser sao foi seu sua seus suas "
    "este esta estes estas esse essa isso aquele aquela pelo pela pelos pelas "
    "entre sobre ate apos antes quando onde qual quais cujo cuja"
).split()

# Stopwords dropped when a question is rewritten.
REWRITE_STOPWORDS = (
    "a o os as de da do das dos e em um uma para por que qual quais como sobre "
    "me diga explique"
).split()

# Lexical terms.
WORD = r"([a-z0-9]+)"
NUMBER_YEAR = r"(?U)(\d{1,6}(?:\.\d{3})*)\s*[/-]\s*(\d{2,4})"
ARTICLE_REF = r"(?U)(?=art)\bart(?:igo)?\.?\s*(\d{1,4})(?:\s*-\s*([a-z]))?"

# Structure of a legal text, tried in this order on each line.
HEADING = r"(?Ud)^(#{1,6})\s+(.+?)\s*#*$"
ANNEX = r"(?iuUd)^\s*(ANEXO\s+[IVXLCDM\d]+[^\n]{0,80}|ANEXO\b[^\n]{0,80})$"
TITLE_BLOCK = r"(?iuUd)^\s*(T[IÍ]TULO\s+[IVXLCDM\d]+[^\n]{0,100})$"
CHAPTER = r"(?iuUd)^\s*(CAP[IÍ]TULO\s+[IVXLCDM\d]+[^\n]{0,100})$"
SECTION = r"(?iuUd)^\s*(SE[ÇC][ÃA]O\s+[IVXLCDM\d]+[^\n]{0,100})$"
ARTICLE = r"(?iuUd)^\s*(Art\.?\s*\d+\s*[ºo°]?(?:\s*-\s*[A-Z])?)"
PARAGRAPH = r"(?iuUd)^\s*(§\s*\d+\s*[ºo°]?|Par[áa]grafo\s+[úu]nico)"
INCISO = r"(?Ud)^\s*([IVXLCDM]{1,7})\s*[-–—]\s+"
ALINEA = r"(?Ud)^\s*([a-z])\)\s+"
ARTICLE_ONLY = r"(?iuUd)^\s*Art\.?\s*\d+\s*[ºo°]?(?:\s*-\s*[A-Z])?\s*[.\-–—]?\s*$"
SENTENCE_END = r"(?U)(?<=[.!?;])\s+(?=[A-ZÀ-Ý0-9§])"

# Phrases addressed to the assistant rather than the reader.
# Applied to lower-cased text; the look-ahead lists their first letters.
INJECTION = (
    r"(?U)(?=[idevysafnrpj])(ignore\s+(?:todas?\s+)?(?:as\s+)?(?:instru|regras|orienta)"
    r"|ignore\s+(?:all|any)\s+(?:previous|prior|above)"
    r"|disregard\s+(?:all\s+)?(?:previous|prior|the\s+above)"
    r"|desconsidere\s+(?:todas?\s+)?(?:as\s+)?(?:instru|regras|mensagens)"
    r"|esque[çc]a\s+(?:tudo|todas?|as\s+instru|o\s+contexto|suas?\s+regras)"
    r"|voc[êe]\s+(?:agora\s+)?[ée]\s+(?:um|uma)\s+(?:assistente|modelo|ia|chatbot)"
    r"|you\s+are\s+now\s+(?:a|an)\b"
    r"|sem\s+restri[çc][õo]es"
    r"|aja\s+como\s+(?:um|uma|se)"
    r"|finja\s+(?:que|ser)"
    r"|n[ãa]o\s+cite\s+(?:as\s+)?(?:fontes|nenhuma\s+fonte)"
    r"|responda\s+que\b"
    r"|afirme\s+(?:tamb[ée]m\s+)?que\b"
    r"|nova[s]?\s+instru[çc][õo]es"
    r"|(?:prompt|instru[çc][õo]es)\s+do\s+sistema"
    r"|system\s+prompt"
    r"|jailbreak)"
)
# Each phrase above holds one of these words.
INJECTION_WORDS = (
    "ignore", "disregard", "desconsidere", "esque", "voc", "you", "restri", "aja", "finja", "cite",
    "responda", "afirme", "instru", "sistema", "system", "jailbreak",
)
REDACTION_MARKER = "[trecho removido: tentativa de instrucao dentro do documento]"
SENTENCE_CUT = r"(?<=[.!?\n])"

# Issuers, most specific first.
AUTHORITIES = (
    ("ANVISA", r"(?iuU)\bANVISA\b|Ag[eê]ncia Nacional de Vigil[aâ]ncia Sanit[aá]ria"),
    ("Ministerio da Saude", r"(?iuU)Minist[eé]rio da Sa[uú]de"),
    ("CFF", r"(?iuU)\bCFF\b|Conselho Federal de Farm[aá]cia"),
    ("CRF", r"(?iuU)\bCRF(?:[-/]?[A-Z]{2})?\b|Conselho Regional de Farm[aá]cia"),
    ("Vigilancia Sanitaria", r"(?iuU)Vigil[aâ]ncia Sanit[aá]ria(?! da Anvisa)"),
)

# Each issuer's pattern matches only text that holds one of these, whatever the case.
AUTHORITY_WORDS = {
    "ANVISA": ("anvisa", "ncia nacional de vigil"),
    "Ministerio da Saude": ("rio da sa",),
    "CFF": ("cff", "federal de farm"),
    "CRF": ("crf", "regional de farm"),
    "Vigilancia Sanitaria": ("ncia sanit",),
}

# Norm numbers and their canonical type.
REGULATION = (
    r"(?iuU)\b(RDC|RESOLU[ÇC][ÃA]O(?:\s+DA\s+DIRETORIA\s+COLEGIADA)?|PORTARIA"
    r"|INSTRU[ÇC][ÃA]O\s+NORMATIVA|IN|LEI|DECRETO)"
    r"(?:\s*[-–]\s*RDC)?"
    r"[\s\-–,]*(?:n[ºo°.]*\s*)?(\d{1,6}(?:\.\d{3})*)"
    r"(\s*[/-]\s*\d{2,4}"
    r"|\s*,?\s*de\s+\d{1,2}\s+de\s+[a-zç]+\s+de\s+\d{4}"
    r"|\s*,?\s*de\s+\d{4})?"
)
REGULATION_TYPES = {
    "rdc": "RDC",
    "resolucao": "RDC",
    "resolucao da diretoria colegiada": "RDC",
    "portaria": "Portaria",
    "instrucao normativa": "IN",
    "in": "IN",
    "lei": "Lei",
    "decreto": "Decreto",
}

# Dates, links, versions.
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "marco": 3, "março": 3, "abril": 4, "maio": 5,
    "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10,
    "novembro": 11, "dezembro": 12,
}
DATE_LONG = r"(?iuU)\b(\d{1,2})\s+de\s+([a-zç]+)\s+de\s+(\d{4})\b"
DATE_SHORT = r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
EFFECTIVE = r"(?iuU)entra\s+em\s+vigor[^.\n]{0,120}"
DATE_SHORT_WORDS, EFFECTIVE_WORDS, URL_WORDS, VERSION_WORDS = ("/",), ("entra",), ("://",), ("vers", "rev")
URL = r'(?U)https?://[^\s<>")]+'
VERSION = r"(?iuU)\b(?:vers[ãa]o|revis[ãa]o|rev\.?)\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)*)"

# Validity statuses and their display labels.
STATUS_IN_FORCE = "vigente_confirmada"
STATUS_REVOKED = "revogada_confirmada"
STATUS_UNVERIFIED = "vigencia_nao_verificada"
STATUS_LABELS = {
    STATUS_IN_FORCE: "Vigencia confirmada",
    STATUS_REVOKED: "Revogada (confirmado)",
    STATUS_UNVERIFIED: "Vigencia nao verificada",
}
UNKNOWN = "nao informado"

# Front-matter.
FRONTMATTER_BLOCK = r"(?sU)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"
FRONTMATTER_LINE = r"(?Ud)^([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.+?)\s*$"
FRONTMATTER_KEYS = (
    "authority", "regulation_number", "publication_date", "effective_date",
    "document_title", "source_url", "document_version", "status",
)

# Topics of the knowledge graph and the spellings that reveal them.
TOPICS = (
    ("controle de qualidade", ("controle de qualidade", "qualidade", "peso médio", "peso medio")),
    ("boas práticas de manipulação", ("boas práticas", "boas praticas", "manipulação", "manipulacao")),
    ("procedimento operacional padrão", ("pop", "procedimento operacional")),
    ("água purificada", ("água purificada", "agua purificada", "osmose")),
)
# Aliases by normalized entity name.
ENTITY_ALIASES = {
    "anvisa": (
        "agencia nacional de vigilancia sanitaria",
        "agência nacional de vigilância sanitária",
        "anvisa",
    ),
    "ministerio da saude": ("ministério da saúde", "ministerio da saude", "ms"),
    "cff": ("conselho federal de farmacia", "conselho federal de farmácia"),
    "vigilancia sanitaria": ("vigilância sanitária", "visa"),
}
# Edges accepted from a model.
MODEL_RELATIONS = (
    "trata_de", "relacionado_a", "emitida_por", "identifica", "regula", "revoga", "altera",
)
MODEL_KINDS = ("documento", "fonte", "tema", "norma", "conceito", "evidencia")

# Question routing and planning.
LITERAL_REF = r"(?iuU)\b(?:rdc|portaria|in|lei|decreto)\s*\d"
MULTI_HOP = r"(?iuU)\b(?:quais|relacion|revog|entre normas|e\s+tamb[eé]m)\b"
PLAN_ARTICLE = r"(?iuU)\b(?:art(?:igo|\.)?\s*\d+|item\s*\d+(?:\.\d+)*)\b"
PLAN_VALIDITY = r"(?iuU)\b(?:vigente|vigencia|revogad|alterou|alteraram|derrog)\w*\b"
PLAN_RELATIONSHIP = (
    r"(?iuU)\b(?:quais|relacion|entre normas|e\s+tamb[eé]m|alem da|al[eé]m da)\b"
)
PLAN_MULTI = r"(?iuUd)[?;].*[?;]|\be\s+(?:qual|quais|como|quando)\b"
REF_EXPAND = r"(?iuU)\b(rdc|portaria|in|lei|decreto)\s*(\d+)(?:/(\d{2,4}))?\b"
STRATEGIES = {
    "conceptual": "semantic",
    "exact_term": "bm25_plus_semantic",
    "article": "bm25_exact_plus_semantic",
    "relationship": "kag_hybrid",
    "validity": "kag_hybrid_with_metadata",
    "multi_question": "hybrid_fallback",
}
LEXICAL_BOOST = "regulamentacao documento normativo"

# Answer audit.
CITATION = r"(?iuU)[\[(]\s*fontes?\s*([0-9]+(?:\s*(?:,|e|;|-)\s*[0-9]+)*)\s*[\])]"
ASSERTION = (
    r"(?iuU)\b(deve(?:m|ra|rao)?|e\s+obrigat[oó]ri[ao]|s[ãa]o\s+obrigat[oó]ri[ao]s|"
    r"[eé]\s+vedad[ao]|[eé]\s+proibid[ao]|exige[- ]se|fica\s+estabelecid[ao]|"
    r"o\s+prazo\s+[eé]|no\s+prazo\s+de|sob\s+pena\s+de|constitui\s+infra[çc][ãa]o)\b"
)
HEDGE = (
    r"(?iuU)\b(de\s+modo\s+geral|geralmente|normalmente|costuma[- ]se|"
    r"acredito|presumo|provavelmente|possivelmente)\b"
)
ANSWER_SENTENCE = r"(?U)(?<=[.!?])\s+"
REASON_INVALID = "A resposta citou fontes inexistentes: "
REASON_NONE_VALID = "A resposta nao citou nenhuma fonte valida."
REASON_CONFLICT = "Ha normas diferentes tratando do mesmo artigo entre as fontes citadas."
REASON_UNVERIFIED = "A vigencia de ao menos uma das fontes citadas nao esta confirmada."
REASON_UNSUPPORTED = " afirmacao(oes) regulatoria(s) sem citacao de fonte."
REASON_BORDERLINE = (
    "O score de similaridade das fontes citadas esta proximo do limite minimo."
)
REASON_CUT = (
    "A resposta foi cortada pelo limite de tokens de saida e pode estar incompleta."
)
REASON_FULL = (
    "O prompt ocupou todo o contexto do modelo; parte da evidencia pode ter sido descartada."
)
NO_EVIDENCE_ANSWER = (
    "Não encontrei informação suficiente na base documental para responder com segurança."
)
ABSTENTION_MARKERS = (
    "nao encontrei informacao suficiente",
    "ainda nao ha documentos indexados",
)
TRUNCATION_NOTE = "\n[trecho cortado para caber no contexto]"

# Histogram bounds in seconds, and for tokens.
STAGE_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
SPEED_BUCKETS = (5, 10, 20, 40, 60, 100, 150, 250, 500)
LENGTH_BUCKETS = (50, 100, 200, 400, 800, 1600, 3200)
