"""Word lists, character classes and labels that results depend on."""

from __future__ import annotations

# --- Characters -------------------------------------------------------------------------------------------------
ARABIC = r"؀-ۿ"
DIACRITICS = r"[ً-ٰٟۖ-ۭ]"
INVISIBLE = r"[​-‏‪-‮﻿]"
TATWEEL = "ـ"
ALEF_VARIANTS = "إأآٱ"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"

# --- Shape of Arabic words --------------------------------------------------------------------------------------
PREFIXES = ["ال", "وال", "بال", "لل", "كال", "فال"]
SUFFIXES = ["ة", "ات", "ون", "ين", "ان", "ية", "ه", "ها", "هم", "كما", "نا", "ي"]
FRAGMENTS = ["ال", "لل", "ون", "ات", "ية", "في", "من", "ان"]
BIGRAMS = ["ال", "لل", "من", "ان", "في", "ية", "ات", "ون", "ين", "ما", "ري", "را", "با", "يا", "تح", "عي", "ذك", "اص", "وا", "مه", "ند", "عل", "تع"]
ODD_STARTS = ["ة", "ى", "ؤ", "ئ"]
ODD_ENDS = ["ا", "و"]

# --- Words that rankings leave out ------------------------------------------------------------------------------
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "with", "from", "by", "this", "that", "it", "as", "at", "be",
    "من", "في", "على", "إلى", "الى", "عن", "مع", "هذا", "هذه", "ذلك", "تلك", "التي", "الذي", "الذين", "اللذين", "ما", "لا", "لم", "لن", "إن", "ان", "أن", "أو", "او", "و", "ثم", "قد", "كان", "كانت", "يكون", "بين", "بعد", "قبل", "عند", "حول", "كل", "بعض", "غير", "أي", "اي", "هناك", "هنا",
]
KEYWORD_STOPWORDS = ["a", "an", "the", "is", "are", "what", "who", "how", "does", "did", "please", "ما", "هل", "من", "في", "عن", "هذا", "هذه", "التي", "الذي"]

# --- Markers of intent ------------------------------------------------------------------------------------------
SUMMARY_EN = ["summarize", "summary", "sum up", "tl;dr", "tldr"]
SUMMARY_AR = ["لخص", "ملخص", "اختصر", "خلاصة"]
SMALL_TALK = ["hello", "hi", "hey", "thanks", "thank you", "good morning", "good evening", "who are you", "what can you do", "مرحبا", "السلام عليكم", "أهلا", "اهلا", "شكرا", "من أنت", "من انت", "كيف حالك"]
PLANNER_SMALL_TALK = ["hello", "hi", "hey", "thanks", "thank you", "who are you", "what can you do", "مرحبا", "السلام", "شكرا", "من أنت", "من انت", "ماذا تستطيع"]
QUESTION_STARTS = ["what", "who", "where", "when", "why", "how", "tell", "explain", "ما", "من", "أين", "اين", "متى", "لماذا", "كيف", "هل", "أخبر", "اشرح", "عن", "موضوع"]
WEB_DIRECT = ["search the web", "search online", "look up online", "browse", "google", "internet", "online", "ابحث في الويب", "ابحث على الإنترنت", "ابحث اونلاين", "تصفح", "الانترنت", "أونلاين"]
PROFILE_EN = ["profile", "account", "handle", "username", "portfolio", "page", "channel", "public repos", "public repository", "public repositories", "public work"]
PROFILE_AR = ["الملف الشخصي", "ملف شخصي", "حساب", "اسم المستخدم", "معرف", "رابط", "اعماله", "أعماله", "المشاريع العامة", "المستودعات العامة", "صفحته", "القناة"]
ASK_EN = ["find", "get", "show", "provide", "give", "fetch", "locate", "summarize"]
ASK_AR = ["هات", "اعطني", "أعطني", "زودني", "زوّدني", "اعرض", "لخص", "لخّص"]
WEB_PATTERNS = [r"\b(search|browse|look up)\b.+\b(web|online|internet)\b", r"\b(latest|current|today)\b.+\b(news|price|score|weather)\b", r"\b(link|url)\b.+\b(profile|account|page)\b"]
DOMAIN_PATTERN = r"\b[a-z0-9-]+\.[a-z]{2,}\b"
SCREENSHOT = ["screenshot", "screen shot", "snapshot", "preview image", "show me image", "لقطة شاشة", "سكرين شوت", "صورة الصفحة", "صوره الصفحه", "صورة للحساب"]
QUERY_COMMAND_EN = r"(?i)^(please\s+)?(search the web for|search online for|search for|look up|find|browse)\s*"
QUERY_COMMAND_AR = r"^(من فضلك\s+)?(ابحث في الويب عن|ابحث عن|ابحث|تصفح)\s*"
QUERY_WH = r"(?i)^(what is|who is|when is|where is)\s+"

# --- Query planning ---------------------------------------------------------------------------------------------
GENERIC_WORDS = ["who", "what", "why", "where", "tell", "about", "story", "king", "prince", "من", "ما", "لماذا", "اين", "احك", "قصة", "ملك", "امير", "الوزير"]
#: Bucket markers and their two context lines; the last bucket is the default.
CONTEXT_NOTES = [
    (["qamar", "قمر", "prince", "أمير"], ["السياق: قصة قمر الزمان ضمن ألف ليلة وليلة.", "مرتبط غالبا بالوزير مرزوان ورحلة الأمير."]),
    (["king", "ملك", "عرائس", "bride"], ["السياق: الحكاية الإطارية عن الملك شهريار وشهرزاد.", "يتعلق بالقتل بعد ليلة ثم السرد لتأجيل التنفيذ."]),
    (["sister", "أخت", "دنيا"], ["السياق: دنيازاد أخت شهرزاد في مطلع الليالي.", "دورها طلب متابعة الحكاية كل ليلة."]),
    (["jar", "jinni", "عفريت", "جرة"], ["السياق: حكاية الصياد والعفريت المحبوس في الجرة.", "يرتبط بالخاتم وسرد النجاة بالحيلة."]),
    ([], ["السياق: السؤال غالبا عن شخصيات ألف ليلة وليلة.", "استخدم أسماء الشخصيات وصيغ الحكاية الإطارية في البحث."]),
]
SPELLING = {
    "scheherazd": "scheherazade", "scheherazad": "scheherazade", "sheherazade": "scheherazade", "shahriyar": "shahryar", "dunyazade": "dunyazad", "alf layla wa lyla": "alf layla wa layla", "1001 night": "1001 nights",
    "شهرزاذ": "شهرزاد", "شهرزاة": "شهرزاد", "شهريارر": "شهريار", "دنيازاة": "دنيازاد", "قمرالزمان": "قمر الزمان", "الف ليله": "الف ليلة", "ألف ليله": "ألف ليلة",
}

# --- Answers ----------------------------------------------------------------------------------------------------
INSUFFICIENT = {
    "ar": "تعذر تحديد الإجابة من الأدلة المتاحة في المستندات.",
    "en": "The answer cannot be determined from the available evidence in the documents.",
    "mixed": "The answer cannot be determined from the available evidence. / تعذر تحديد الإجابة من الأدلة المتاحة.",
}
NO_SOURCES = "Sources:\n- No matching passages were retrieved from the uploaded documents."

# --- Files ------------------------------------------------------------------------------------------------------
MIME_BY_EXTENSION = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "gif": "image/gif",
    "txt": "text/plain", "text": "text/plain", "log": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
#: Leading bytes in hexadecimal.
MAGIC = [("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("474946383761", "image/gif"), ("474946383961", "image/gif")]
UNSAFE_IN_NAMES = r'[\x00-\x1f\x7f<>:"|?*\\/]+'
UUID_DNS = "6ba7b8109dad11d180b400c04fd430c8"

# Messages where nothing was retrieved, and the plan text of a route.
NOT_IN_DOCUMENTS = {"ar": "تعذر تحديد الإجابة من المستندات المرفوعة.", "en": "The answer cannot be determined from the uploaded documents."}
NOT_IN_KNOWLEDGE = {"ar": "تعذر العثور على معلومات كافية في قاعدة المعرفة.", "en": "Not enough information was found in the knowledge database."}
ROUTE_PLANS = {
    "query_documents": "Retrieve → trust-layer read → grounded answer + citations",
    "summarize_document": "Ingest (if needed) → summarize document",
    "query_knowledge_base": "Database → READ-only query plan → hybrid BM25+vector retrieve → answer",
    "web_search": "Search Internet → live web lookup → grounded answer",
    "call_model": "General conversation",
}
EMPTY_KNOWLEDGE_PLAN = "Database selected but knowledge base is empty — general chat"

# How the headings of a footer with sources begin, in lower case.
FOOTERS = ("source analysis (trust layer)", "sources:", "sources (top", "_sources:_")
