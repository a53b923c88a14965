"""Word lists and patterns of the text operators.

Fixed values: they decide results and are stated as they are.
"""

STOP_EN = (
    "the a an is are was were be been being have has had do does did will would shall should may might can could of in to "
    "for on with at by from as into about between through during before after above below and or but not no nor so if then "
    "that this these those it its he she we they you i my your his her our their me him us them"
).split()
STOP_RU = (
    "и в не на с что как по это он она они мы вы я а но за то все его её их этот эта эти из к у так уже от при бы до который "
    "когда только или тоже ещё более"
).split()
STOP_KK = (
    "және мен бұл сол үшін бойынша сияқты өте бар жоқ емес болып туралы қажет негізгі арқылы бірге дейін кейін немесе әрі "
    "тағы бірақ да де дерек мәлімет жүйе деңгей"
).split()
STOPWORDS = sorted({*STOP_EN, *STOP_RU, *STOP_KK})

GENERIC_TERMS = (
    "such type kind form sort other common include includes used provide provides process term service services product "
    "products түр нысан санат жалпы негізгі мысал қызмет услуга пример форма категория процесс"
).split()
GENERIC_LABELS = (
    "such type kind form sort other common include includes used provide provides process term service services product "
    "products такой такие тип вид форма түр нысан санат жалпы негізгі қызмет процесс"
).split()
GENERIC_PARENTS = "thing entity object item category class group set kind type түр санат топ".split()
CONNECTORS = "and or и или және немесе".split()
UNIT_TOKENS = (
    "kw mw gw kwh mwh gwh twh wh ah mah cm cm2 cm3 mm kv hz kg mg lb doi isbn issn pmid bmatrix latex fig table et al"
).split()
TECH_LABEL_TOKENS = "kw mw gw kwh mwh gwh twh ah mah cm cm2 cm3 mm kv hz mg kg doi isbn issn pmid bmatrix latex fig table".split()
BAD_SINGLES = (
    "use used using include includes including provide provides allow allows make makes show shows occur occurs work works "
    "begin end also which usually many significant typically over major mostly often much several various high low new old "
    "good bad large small different same general specific important common main basic certain other another more less most "
    "least than түр нысан санат жалпы негізгі мысал қызмет бұл сол яғни демек также пример процесс категория"
).split()
BAD_LABEL_PARENTS = (
    "also which usually many significant typically over major mostly often much several various около примерно также том "
    "числе кез кезінде үшін арқылы және мен"
).split()
BAD_LABEL_SINGLES = (
    BAD_LABEL_PARENTS
    + (
        "high low new old good bad large small different same general specific important common main basic certain other "
        "another more less most least than түр санат негізгі жалпы қызмет мысал"
    ).split()
)
BAD_PARENT_SINGLES = (
    "also which usually many significant typically over major mostly often much several various about around including "
    "include among during том числе около примерно также кез кезінде үшін арқылы мен және немесе"
).split()
BAD_TERM_PHRASES = (
    "том числе", "в том числе", "составляет около", "около", "включая", "соның ішінде", "кез келген", "атап айтқанда",
    "үшін", "арқылы",
)
BAD_LABEL_PHRASES = ("том числе", "в том числе", "составляет около", "около", "кез келген", "соның ішінде", "атап айтқанда")
BAD_PARENT_PHRASES = ("том числе", "в том числе", "составляет около", "около", "кез келген", "соның ішінде")
FUNCTIONAL = {
    "en": "for to from between after before during which when while because including such some many".split(),
    "ru": "для между после до кроме того даже одна является составляет представляют через при".split(),
    "kk": "үшін арқылы ретінде болып кезінде сияқты ететін және мен немесе".split(),
}
FUNCTIONAL_PARENTS = (
    "for to from between after before during which when while для между после до кроме того даже одна через үшін арқылы "
    "ретінде болып кезінде сияқты және мен"
).split()
VERBISH_SUFFIXES = "ing ed ize ise ать ять ить еть ться ған ген атын етін ып іп".split()
KK_PARTICIPLES = "ған ген қан кен атын етін йтын йтін ушы уші".split()
KK_VERBAL_TAILS = "алу беру ету болу шығару жасау қою келу кету".split()
NOISE_PATTERNS = (
    r"^(?:doi|isbn|issn|pmid)(?:[^\p{L}\p{N}_]|$)",
    r"^[a-z]{1,2}[0-9]+[a-z0-9]*$",
    r"^[0-9]+[a-z]{1,3}$",
    r"(?:^|[^\p{L}\p{N}_])(?:bmatrix|latex|arxiv)(?:[^\p{L}\p{N}_]|$)",
)

HEADER_PREFIXES = (
    "source:", "language:", "title:", "url:", "retrieved:", "author:", "authors:", "категория:", "источник:", "тілі:",
    "дереккөз:",
)
BANNERS = ("from wikipedia", "материал из википедии")

KAZAKH_LETTERS = "әғқңөұүһі"
LANG_STOP_KK = (
    "және мен бұл сол үшін бойынша сияқты өте бар жоқ емес болып туралы қажет негізгі құрал деңгей жүйе мәлімет дерек "
    "арқылы бірге"
).split()
LANG_STOP_RU = "и в на по для что как это не но при из к от до уже если также данные система уровень документ через".split()

METHOD_WEIGHTS = {
    "hearst": 0.72, "hearst_trigger_fallback": 0.62, "embedding_clustering": 0.64,
    "embedding_clustering_secondary_parent": 0.60, "embedding_clustering_relaxed": 0.56, "component_bridge": 0.58,
    "orphan_safe_link": 0.55,
}
OTHER_METHOD_WEIGHT = 0.60
CONNECTIVITY_MIN_SCORES = {
    "component_bridge": 0.56, "component_anchor_bridge": 0.62, "orphan_safe_link": 0.58,
    "connectivity_repair_fallback": 0.56, "hearst_trigger_fallback": 0.62,
}
RECOVERY_METHODS = ("component_bridge", "component_anchor_bridge", "connectivity_repair_fallback", "orphan_safe_link")
POSITIVE_LABELS, NEGATIVE_LABELS = ("accepted", "approve", "approved", "true"), ("rejected", "reject", "false")
