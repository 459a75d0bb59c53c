"""Fixed word lists of the text operators, kept together as plain data."""

from __future__ import annotations

# --- fixed values: abbreviations that are always followed by more of their sentence
TITLES = frozenset(
    "dr mr mrs ms prof st jr dott sig sra sr dra dña mme mlle m г г-н г-жа дж"
    " д डॉ श्री د أ ดร".split()
)
# --- fixed values: abbreviations that continue when a number follows
BEFORE_NUMBER = frozenset(
    "no nr n núm num nº p pp pág págs vol bd s стр с т гл ص ج सं पृ खं fig abb cap kap ch art §".split()
)
# --- fixed values: abbreviations that never close a sentence
INSIDE = frozenset(
    "e.g i.e vgl cf cfr bzw z.b d.h u.a vs etc. approx aprox env ca circa см т.е т.д т.п напр प्रा".split()
)
# --- fixed values: (word before, last word) of two-word abbreviations that never close a sentence
INSIDE_PAIRS = frozenset(
    [("p", "ex"), ("p", "ej"), ("por", "ej"), ("per", "es"), ("z", "b"), ("d", "h"), ("u", "a"), ("т", "е"), ("т", "п"), ("par", "ex")]
)
# --- fixed values: Arabic words that carry a sentence on after an abbreviation
ARABIC_CONTINUES = frozenset(
    "في من إلى على عن مع قبل بعد عند أثناء خلال خلف قرب أمام تحت فوق بين منذ حتى حول ضد كما أمس اليوم غدا يوم هذا هذه"
    " الأسبوع الشهر العام مساء صباحا ظهرا ليلا أيضا فقط ثم حيث التي الذي بشأن لمدة".split()
)
# --- fixed values: Arabic words with the letter lam that open a sentence, not a preposition with its noun
ARABIC_LAM_OPENERS = ("لا", "لم", "لن", "لقد", "لكن", "ليس", "لماذا", "لذلك", "لهذا", "لدي", "لعل", "لو")
# --- fixed values: Arabic connectives that open a sentence although their first word could carry one on
ARABIC_OPENERS = (
    "في هذه الأثناء",
    "في النهاية",
    "في الواقع",
    "على سبيل المثال",
    "على أي حال",
    "مع ذلك",
    "بعد ذلك",
    "من ناحية أخرى",
    "من كان",
)
# --- fixed values: log odds that a sentence written without spaces ends after a word (Japanese, Chinese, Thai)
FINAL_WORDS = (
    (3.0, "です ます ました ません でした でしょう ましょう ください ですか ますか ましたか ですね ますね ですよ ますよ 吗 嗎 了吗"),
    (2.0, "だ だった だよ だね ない よね かな わね 吧 呢 呀 啦 了吧 ครับ ค่ะ คะ นะคะ นะครับ"),
    (1.0, "た る い よ ね か わ ぞ さ 了 啊 哦 的话 好了 นะ ล่ะ แล้ว"),
    (-5.0, "は が を に で と の も へ や から まで より など って ので のに けど て し ば たり ながら その この あの どの"),
    (-5.0, "和 与 與 及 或 在 把 被 从 從 对 對 跟 向 给 給 为 為 是 很 最 更 不 没 沒 一个 一個 这 那 这个 那个 的 地 得 所 以 而 且 但 因为 因為 如果 虽然 雖然"),
)
# --- fixed values: log odds that a sentence written without spaces begins with a word (Japanese, Chinese, Thai)
OPENING_WORDS = (
    (3.0, "しかし だから ところで つまり けれども ただし ところが 但是 不过 不過 所以 因此 然而 可是 于是 於是 另外 与此同时 與此同時 แต่ ดังนั้น"),
    (1.5, "私は 私が 私たちは 僕は 俺は 彼は 彼女は 彼らは あなたは これは それは あれは ここは また でも そして それから それで それに 同時に 結局 実は いつものように 例えば たとえば もし なぜ どうして 今日は 昨日 明日 さて"),
    (2.0, "然后 然後 而且 其实 其實 同时 同時 后来 後來 最后 最後 比如 比如说 例如 说实话 没想到 老实说"),
    (1.5, "我 我们 我們 你 你们 你們 您 他 他们 他們 她 她们 它 它们 这是 這是 那是 大家 谁 請 请 为什么 為什麼 怎么 怎麼 如果 今天 昨天 明天 现在 現在 เรา ผม เขา ฉัน"),
    (-5.0, "は が を に で と の も へ や です ます ました さん 的 了 着 著 过 過 们 們 吗 吧 呢 和 与 與 及 或 地 得"),
)
# --- fixed values: Thai company words around a name
THAI_COMPANY_BEFORE = ("บริษัท", "ห้างหุ้นส่วน", "หจก.", "บจก.")
THAI_COMPANY_AFTER = ("จก.", "จำกัด", "มหาชน")

# --- fixed values: hesitation sounds by language; the last letter may be drawn out
FILLERS = {
    "en": "uh um erm hmm hm uhm er mm mhm".split(),
    "de": "äh ähm öh öhm hm hmm".split(),
    "es": "em eh ehm mmm eeh".split(),
    "fr": "euh heu beuh hum euhm".split(),
    "it": "ehm eeh uhm mmm".split(),
    "pt": "ahn hã hum ééé hmm".split(),
    "ru": "э-э эм ммм хм э-э-э".split(),
    "ar": "اممم إممم همم آآآ".split(),
    "hi": "उम्म उह अं हम्म".split(),
    "ja": "あのー えー えーと えっと ええと うーん".split(),
    "ko": "음 어 으음 흠".split(),
    "zh": "嗯 呃 额 唔".split(),
    "th": "อืม เอ่อ อ่า".split(),
}
# --- fixed values: names of sounds in annotations
SOUNDS = (
    "music|applause|laughter|laughs|laughing|coughs|coughing|cough|sighs|sigh|silence|noise|inaudible|crosstalk|cheering|clapping|chuckles|pause",
    "musik|applaus|gelächter|hustet|husten|lachen|lacht|seufzt|stille|rauschen",
    "música|aplausos|risas|tose|tos|suspira|silencio|ruido",
    "musique|applaudissements|rires|il tousse|elle tousse|tousse|toux|soupir|silence|bruit",
    "musica|applausi|risate|tossisce|tosse|sospira|silenzio|rumore",
    "risos|tosse|suspiro|silêncio|ruído",
    "музыка|аплодисменты|смех|кашляет|кашель|вздох|тишина|шум",
    "موسيقى|تصفيق|ضحك|سعال|تنهد|صمت|ضوضاء",
    "संगीत|तालियाँ|हँसी|खाँसी|शोर|सन्नाटा",
    "音楽|拍手|笑い|笑い声|笑|咳|咳払い|雑音|沈黙",
    "음악|박수|웃음|기침|한숨|소음|침묵",
    "音乐|掌声|笑声|咳嗽|叹气|噪音|沉默|鼓掌",
    "ดนตรี|เสียงดนตรี|เสียงเพลง|เสียงปรบมือ|เสียงหัวเราะ|เสียงไอ|เสียงรบกวน",
)
# --- fixed values: column entries that name nobody
NOBODY = frozenset(["", "?", "??", "unknown", "n/a", "none", "null", "-", "unk", "speaker"])

# --- fixed values: languages and the ways a label may spell them (codes, English and native names)
LANGUAGE_NAMES = {
    "ar": "ara arabic العربية",
    "de": "deu ger german deutsch",
    "en": "eng english",
    "es": "spa spanish español castellano",
    "fr": "fra fre french français",
    "hi": "hin hindi हिन्दी",
    "it": "ita italian italiano",
    "ja": "jpn japanese 日本語",
    "ko": "kor korean 한국어",
    "pt": "por portuguese português",
    "ru": "rus russian русский",
    "th": "tha thai ไทย",
    "zh": "zho chi chinese mandarin 中文",
}
# --- fixed values: labels that name no language
NO_LANGUAGE = frozenset(["", "?", "??", "???", "n/a", "na", "none", "null", "unknown", "unk", "und", "mul", "mis", "zxx", "xx", "xxx", "-", "--", "other"])
# --- fixed values: romanisation of Cyrillic
CYRILLIC_LATIN = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
        "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "),
        strict=True,
    )
)
# --- fixed values: romanisation of Devanagari: consonants, vowels, vowel signs
DEVANAGARI_CONSONANTS = dict(
    zip(
        "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह",
        "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h".split(),
        strict=True,
    )
)
DEVANAGARI_VOWELS = dict(zip("अआइईउऊऋएऐओऔऑ", "a aa i ee u oo ri e ai o au o".split(), strict=True))
DEVANAGARI_SIGNS = dict(zip("ािीुूृेैोौॉंँः", "aa i ee u oo ri e ai o au o n n h".split(), strict=True))

# --- fixed values: texts that stand for a missing translation
PLACEHOLDERS = frozenset(
    "null none nil nan na n/a n.a undefined todo tbd tba fixme xxx empty blank missing no_translation untranslated placeholder".split()
    + ["no translation", "not translated", "translation missing", "to be translated", "empty string", "no text", "no output", "lorem ipsum", "not available"]
)
# --- fixed values: words that frame a copied or translated text
FRAMES = frozenset(
    "translation translated übersetzung traducción traduction traduzione tradução перевод 翻訳 翻译 译文 번역 ترجمة الترجمة अनुवाद คำแปล"
    " source original text output answer result target here is the".split()
)
# --- fixed values: how a translator declines, by language
REFUSALS = (
    r"(?:can'?t|can’t|cannot|can not|could not|unable to|won'?t be able to|won’t be able to|must decline|have to decline|decline to"
    r"|(?:not|n[o'’]t) (?:feel )?comfortable|not have enough|n[o'’]t have enough|refuse to|not able to)\b[^.!?]{0,40}?\b(?:translat\w*|render\w*|process\w*|comply\w*|fulfil\w*"
    r"|assist(?: you)? with|help(?: you)? with (?:that|this|your request)|provide (?:a |this |that )?(?:translation|text|content)|this (?:request|instruction|content|passage))",
    r"as an? (?:ai|artificial intelligence|language model|large language model)\b",
    r"against my (?:guidelines|policy|policies|programming)",
    r"(?:no puedo|no me es posible|me es imposible|no soy capaz de|no podré|me niego a)[^.!?]{0,40}(?:traduc\w+|esa petición|esta petición|esa solicitud|esta solicitud|este contenido)|como (?:un )?modelo de lenguaje|como (?:una )?(?:ia|inteligencia artificial)\b",
    r"(?:ne peux (?:pas|malheureusement pas)|ne puis|m'est impossible|m’est impossible|ne suis pas en mesure|refuse de)[^.!?]{0,40}(?:tradui\w+|traduction|cette demande|ce contenu)|en tant que modèle de langu\w+|en tant qu['’]ia\b",
    r"(?:kann|darf|werde|möchte)[^.!?]{0,40}\b(?:nicht|keine)\b[^.!?]{0,30}(?:übersetz\w*|anfrage)|übersetzung[^.!?]{0,40}nicht möglich|(?:bei dieser anfrage|mit dieser anfrage) nicht|als (?:sprachmodell|ki)\b",
    r"(?:non posso|non mi è possibile|mi è impossibile|non sono in grado|non riesco)[^.!?]{0,40}(?:tradu\w+|questa richiesta|questo contenuto)|(?:come|in quanto) modello linguistico|in qualità di modello",
    r"(?:não posso|não consigo|não me é possível|é-me impossível|não sou capaz)[^.!?]{0,40}(?:traduz\w+|tradução|esse pedido|este pedido|deste conteúdo)|como (?:um )?modelo de linguagem",
    r"(?:не могу|не смогу|не в состоянии|невозможно)[^.!?]{0,40}(?:перевест\w+|перевод\w*|эт(?:им|ой|у) (?:запрос\w*|просьб\w*)|с этим запросом)|перевод[^.!?]{0,40}(?:невозможен|не могу|не представляется)|как языковая модель|будучи языковой моделью",
    r"翻訳(?:は|を|することは)?(?:でき|いたしかね|致しかね|お断り)|訳文[はを]?[^。]{0,12}(?:かねます|できません)|言語モデルとして|AIとして|お応えできません",
    r"번역(?:문)?(?:을|를|은|는)?\s*(?:할|해 드릴|제공할|제공하기|제공해)[^.!?]{0,12}(?:없|어렵)|언어 모델(?:로서|이므로|로써)|그 요청은 도와",
    r"(?:无法|不能|不便|难以|没法|拒绝)[^。！？]{0,8}(?:翻译|提供[^。！？]{0,8}(?:译文|翻译)|完成(?:这个|该|此)请求|处理(?:这个|该|此)请求)|作为(?:一个)?(?:AI|人工智能|语言模型|大?语言模型)",
    r"(?:لا أستطيع|لا يمكنني|يتعذر علي|لا أقدر|غير قادر)[^.!؟]{0,30}(?:ترجم\w*|هذا الطلب|المحتوى)|بصفتي نموذج|كنموذج لغ",
    r"अनुवाद[^।!?]{0,40}(?:नहीं (?:कर|दे)|संभव नहीं|असमर्थ)|भाषा मॉडल होने|अनुरोध में मदद नहीं",
    r"ไม่สามารถ(?:แปล|ให้คำแปล|ช่วย(?:เหลือ)?(?:ใน|กับ|ตาม)?คำขอ)|ไม่อาจ(?:แปล|ให้คำแปล)|(?:แปล|คำแปล)[^.]{0,20}ไม่ได้|ในฐานะ(?:แบบจำลอง|โมเดล)ภาษา",
)
# --- fixed values: marks that may close a complete text
TERMINAL = ".!?。！？؟।॥…‥"
# --- fixed values: words that read the same in every language
SHARED_WORDS = frozenset("ok okay tv dj vip ceo ai app wifi internet email www".split())
# --- fixed values: pieces of text of which every refusal holds at least one
REFUSAL_STEMS = tuple(
    "translat|render|process|comply|fulfil|assist|help|provide|request|instruction|content|passage|as an ai|as a ai|as an artificial|as a artificial|as a language|as an language|as a large|as an large"
    "|guideline|policy|policies|programming|traduc|petición|solicitud|contenido|modelo de leng|como ia|como una ia|inteligencia artificial"
    "|tradui|demande|contenu|tant que mod|tant qu'ia|tant qu’ia|übersetz|anfrage|sprachmodell|als ki|tradu|richiesta|contenuto|modello|pedido|conteúdo|modelo de ling"
    "|перев|запрос|просьб|языков|翻訳|訳文|モデル|お応え|aiとして|번역|언어|요청|翻译|译文|请求|作为|ترجم|الطلب|المحتوى|نموذج|अनुवाद|मॉडल|अनुरोध|แปล|คำขอ|โมเดล|แบบจำลอง".split("|")
)
# --- fixed values: Thai vowels that are written before their consonant
LEADING_VOWELS = ("เ", "แ", "โ", "ใ", "ไ")
