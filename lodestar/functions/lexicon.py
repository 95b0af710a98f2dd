"""Term lists, aliases, volumes and phrases that results depend on."""

TERMS = {
    "般若": ["智慧", "prajñā", "prajna", "prajnaparamita", "波羅蜜", "波羅密"],
    "空性": ["śūnyatā", "sunyata", "空", "空相", "真空"],
    "緣起": ["pratītyasamutpāda", "pratityasamutpada", "十二因緣", "因緣"],
    "十二因緣": ["緣起", "因緣", "十二緣起"],
    "涅槃": ["nirvāṇa", "nirvana", "泥洹"],
    "菩提心": ["菩提", "發心", "願菩提心", "bodhicitta"],
    "菩提": ["bodhi", "覺", "阿耨多羅", "菩提心"],
    "四諦": ["苦諦", "集諦", "滅諦", "道諦"],
    "八正道": ["正見", "正思惟", "正語", "正業", "正命", "正精進", "正念", "正定"],
    "菩薩行": ["菩薩", "六度", "波羅蜜", "波羅密", "菩薩道"],
    "淨土": ["極樂", "西方淨土", "西方", "阿彌陀", "安樂世界"],
    "阿羅漢果": ["阿羅漢", "羅漢", "應供", "殺賊", "無生"],
    "阿羅漢": ["羅漢", "阿羅漢果", "應供", "殺賊"],
    "阿含": ["āgama", "agama", "法歸"],
    "戒律": ["律藏", "vinaya", "禁律", "戒法"],
    "律藏": ["vinaya", "戒律", "禁律"],
    "禪定": ["禪那", "三昧", "samādhi", "定", "坐禪"],
    "禪那": ["dhyāna", "三昧", "samādhi", "定", "禪定"],
    "無常": ["anitya", "impermanence"],
    "無我": ["anātman", "anatman", "非我"],
    "中道": ["madhyamā", "middle way", "八不中"],
    "如來": ["tathāgata", "tathagata", "佛"],
    "眾生": ["sattva", "有情"],
}

ALIASES = {
    "長阿含": "T01n0001", "長阿含經": "T01n0001", "阿含經": "T01n0001",
    "大品般若": "T02n0223", "般若波羅蜜": "T02n0223", "般若波羅蜜多": "T02n0223",
    "金剛經": "T08n0235", "金剛般若波羅蜜經": "T08n0235", "金剛般若波羅蜜": "T08n0235", "金剛般若": "T08n0235",
    "心經": "T08n0251", "般若心經": "T08n0251", "法華經": "T09n0262", "妙法蓮華": "T09n0262",
    "華嚴經": "T10n0279", "大方廣佛華嚴": "T10n0279", "阿彌陀經": "T12n0360", "無量壽經": "T12n0361",
    "觀無量壽經": "T12n0365", "摩訶僧祇律": "T24n1461", "楞嚴經": "T19n0945", "解深密經": "T16n0675",
    "維摩詰經": "T14n0475", "地藏經": "T13n0412", "壇經": "T48n2008",
}

BOOSTS = {
    "緣起": ["T01", "T02"], "因緣": ["T01", "T02"], "十二因緣": ["T01", "T02"], "十二緣起": ["T01", "T02"],
    "四諦": ["T01", "T02"], "八正道": ["T01", "T02"], "無常": ["T01", "T02"], "無我": ["T01", "T02", "T08"],
    "涅槃": ["T01", "T02", "T09"], "般若": ["T06", "T08", "T02"], "空性": ["T06", "T08", "T02"],
    "菩提心": ["T09", "T10", "T14", "T02"], "菩提": ["T09", "T10", "T14", "T02", "T08"],
    "菩薩行": ["T09", "T10", "T14"], "菩薩": ["T09", "T10", "T14"], "淨土": ["T12", "T09", "T10"], "阿彌陀": ["T12", "T36"],
    "戒律": ["T23", "T24", "T01", "T02"], "律藏": ["T23", "T24", "T01", "T02"], "阿羅漢果": ["T01", "T02"], "阿羅漢": ["T01", "T02"],
    "禪定": ["T01", "T02", "T48", "T15"], "禪那": ["T01", "T02", "T48", "T15"], "中道": ["T01", "T02", "T08", "T09"],
}

FILLERS = ["佛經中如何說", "佛經中怎麼說", "佛經中如何記載", "佛經中", "如何說", "怎麼說", "如何記載", "請問", "請解釋", "什麼是", "何謂"]

#: (any of these in the question, extra terms), in order; the eighth adds its term only if absent.
EXTRAS = [
    (["緣起", "十二因緣", "四諦", "八正道", "無常", "無我", "涅槃", "中道", "阿羅漢"], ["阿含", "長阿含經", "中阿含經", "雜阿含經", "增一阿含經"]),
    (["菩提"], ["法華經", "華嚴經", "發菩提心", "願成佛", "菩薩發心"]),
    (["無我"], ["阿含", "五蘊", "色受想行識", "非我", "金剛經"]),
    (["淨土"], ["阿彌陀經", "極樂世界", "無量壽", "無量壽經", "觀無量壽經", "念佛", "西方極樂"]),
    (["戒"], ["波羅提木叉", "戒經", "比丘戒", "摩訶僧祇律", "四分律", "十誦律", "僧祇律"]),
    (["禪定", "禪那"], ["坐禪", "入定", "壇經", "六祖"]),
    (["十二因緣"], ["無明", "老死", "生滅"]),
    (["緣起"], ["因緣"]),
    (["中道"], ["八正道", "正見", "中阿含經"]),
]

INTENTS = [("provenance", "出處|哪部經|何經|經名"), ("citation", "原文|經文|怎麼說|如何記載")]
GREETING = r"(?i)^\s*(hi|hello|hey|你好|您好|哈囉|在嗎|在吗|嗨)\s*[!！?？.。~～]*\s*$"
PROFILES = [("pali_source", "(?iu)巴利|巴利文|Pāli|Pali|tipiṭaka|三藏"), ("sanskrit_lexicon", "(?iu)梵文|梵語|sanskrit|天城")]
MODES = ["translate", "ocr", "deep_think", "canon_rag", "chat", "model_admin"]
DELIMITERS = "。！？\n"
SPECIALIST_RANGE = (0x0F00, 0x0FFF)

#: Introductions of the answer prompts: with passages for scoped and open questions, and without any.
PROMPTS = {
    "scoped": "Answer from the passages below and cite them by their coordinates.",
    "open": "Answer from the passages below: first the main points, then each with the passages that support it, cited by their coordinates.",
    "empty": "No passage was found. Answer with caution and do not invent sources.",
}
