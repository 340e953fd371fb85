"""Masking with ordered rules and auditable counts; rule packs are data.

A rule is (category, pattern, replacement). Rules run in order, as an earlier mask
hides later hits, and each counts on the text that it sees.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import strip

MASK = "XXX"

# The delivery rules in their order. Groups before the value stay ($1).
DELIVERY_RULES: list[tuple[str, str, str]] = [
    ("credential_value", r"(?i)(\b(?:password|passwd|passcode|api[ _-]?key|secret|access[ _-]?token|refresh[ _-]?token|bearer)\b\s*[:=]\s*)([^\s,;}'\"\]]{3,})", "$1" + MASK),
    ("credential_value", r"(?i)((?:密码|密碼|验证码|驗證碼|口令|门禁(?:码|号|號)?|門禁(?:碼|號)?|PIN|OTP)(?:\s*(?:是|为|係|為))?\s*[:：=#]?\s*)([A-Za-z0-9][A-Za-z0-9_.-]{3,})", "$1" + MASK),
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9_-])", MASK),
    ("api_token", r"(?i)(?:sk-[A-Za-z0-9_-]{20,}|pk-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{20,}|gh[pousr]_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})", MASK),
    ("bearer_token", r"(?i)\bBearer[ \t]+[A-Za-z0-9._~+/=-]{16,}", MASK),
    ("phone_formatted", r"(?<![A-Za-z0-9])(?:\+?(?:86|852)|00?852|0[1-9][0-9]{2})[ ()-]*[0-9]{3,4}[ -][0-9]{3,4}(?![A-Za-z0-9])", MASK),
    ("phone_mobile", r"(?<![A-Za-z0-9])1[3-9][0-9]{9}(?![A-Za-z0-9])", MASK),
    ("phone_plain_hk", r"(?<![A-Za-z0-9])[2-9][0-9]{3}[ -][0-9]{4}(?![A-Za-z0-9])", MASK),
    ("credit_card", r"(?<![A-Za-z0-9])(?:[0-9]{4}[ -]?){3,4}[0-9]{1,4}(?![A-Za-z0-9])", MASK),
    ("url", r"(?i)\bhttps?://[^\s\"<>]+", MASK),
    ("local_path", r"/(?:Users|home)/[^\s\"'<>\\]+", MASK),
    ("license_plate", r"(?<![A-Za-z0-9])[\u4e00-\u9fff][A-Z][A-Z0-9]{5}(?![A-Za-z0-9])", MASK),
    ("participant_id", r"(?<![A-Za-z0-9])A[0-9]+_[A-Z][A-Z0-9_-]+(?![A-Za-z0-9])", MASK),
    ("anonymized_user", r"(?i)(?<![A-Za-z0-9])User[ _-]?[A-Z0-9]+(?![A-Za-z0-9])", MASK),
    ("payment_amount", r"(?i)(?:HK\$|RMB|[$¥￥])\s*[0-9]+(?:\.[0-9]{1,2})?(?![A-Za-z0-9])", MASK),
    ("payment_merchant", r"((?:商户|收款方|付款方|支付金额|付款金额|交易金额|金额)\s*[:：]?\s*)([^\s,;}'\"\]]{1,32})", "$1" + MASK),
    ("address_value", r"((?:地址|住址|现居住地址|收货地址|邮编|邮政编码)\s*[:：]?\s*)([^,。；\]}\"']{2,80})", "$1" + MASK),
]

# The placeholder rules of de-identification that need no private configuration.
PLACEHOLDER_RULES: list[tuple[str, str, str]] = [
    ("key", r"\b(?:sk-|pk-|AIza|ghp_|gho_|AQ\.)[A-Za-z0-9_\-]{16,}", "X"),
    ("email", r"[A-Za-z0-9._%+-]+@(?!example\.com)[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "email_x@example.com"),
    ("mobile", r"\b(?:\+?86)?1[3-9]\d{9}\b", "XXX-XXXX-XXXX"),
    ("identity", r"\b\d{17}[\dXx]\b", "XXXXXXXXXXXXXXXXXX"),
    ("digit_groups", r"(?<![0-9a-fA-F-])\b\d{4}[- ]\d{4}(?:[- ]\d{4})?\b(?![0-9a-fA-F-])", "XXX-XXXX-XXXX"),
    ("public_ip", r"\b(?!127\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)(?:\d{1,3}\.){3}\d{1,3}\b", "0.0.0.0"),
    ("mac_home", r"/Users/(?!UserX\b)[A-Za-z0-9_.-]+", "/Users/UserX"),
    ("home", r"/home/(?!userx\b)[A-Za-z0-9_.-]+", "/home/userx"),
    ("code_handle", r"https?://github\.com/(?!User_X\b)([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)", "https://github.com/User_X/$2"),
    ("social_handle", r"https?://(?:www\.)?(?:linkedin\.com/in|twitter\.com|x\.com|instagram\.com|facebook\.com)/[A-Za-z0-9_.-]+", "https://social.example.com/User_X"),
    ("chat_id", r"(?i)\b(wechat|weixin|微信|qq)\s*(?:id|号)\s*[:：]\s*[A-Za-z0-9_-]{4,}", "$1 id: User_X"),
    ("titled_name", r"\b(Prof\.|Dr\.|Professor|Mr\.|Ms\.|Mrs\.)\s+(?!User\b|X\b|Person\b)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", "$1 X"),
]

# Chinese family names and titles that follow a name.
FAMILY_NAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐"
    "费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁"
    "杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍"
)
NAME_TITLES = "老师|教授|同学|博士|师兄|师姐|导师|学长|学姐"


def placeholder_rules(institutions: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """All de-identification rules; ``institutions`` maps a placeholder to the pattern of the names that it stands for."""
    named = [("institution", f"(?i){pattern}", new) for new, pattern in (institutions or {}).items()]
    titled = [r for r in PLACEHOLDER_RULES if r[0] == "titled_name"]
    return [r for r in PLACEHOLDER_RULES if r[0] != "titled_name"] + named + titled + [("chinese_titled_name", f"[{FAMILY_NAMES}]({NAME_TITLES})", "X$1")]


def placeholder_audit_categories(institutions: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """What the de-identification report counts."""
    by = {c: p for c, p, _ in PLACEHOLDER_RULES}
    named = [(f"institution {new}", f"(?i){pattern}") for new, pattern in (institutions or {}).items()]
    return named + [
        ("email", by["email"]), ("mobile", by["mobile"]), ("identity", by["identity"]), ("public_ip", by["public_ip"]), ("mac_home", by["mac_home"]), ("key", by["key"]),
        ("code_handle", r"https?://github\.com/(?!User_X\b)[A-Za-z0-9_.-]+/"),
        ("titled_name", r"\b(?:Prof\.|Dr\.|Professor|Mr\.|Ms\.|Mrs\.)\s+(?!User\b|X\b|Person\b)[A-Z][a-z]+"),
        ("chinese_titled_name", f"[{FAMILY_NAMES}](?:{NAME_TITLES})"),
    ]


# What merging counts besides the plain names of schools, and the placeholders that show that a text was cleaned.
MERGE_AUDIT = [
    ("school_generic", r"(?i)\b[A-Z][a-z]+ (?:University|College)\b"),
    ("email_plain", r"[A-Za-z0-9._%+-]+@(?!example\.com)[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone_plain", r"\b(?:\+?86)?1[3-9]\d{9}\b|\b\d{4}[- ]\d{4}\b"),
    ("anonymized_placeholders", r"University X|School X|User [A-Z]\b|email_x@|XXX-XXXX-XXXX|Address X"),
]


def archived_rules(institution: str | None = None) -> list[tuple[str, str, str]]:
    """The rules of the second delivery version, in their order; ``institution`` is the pattern of names to mask."""
    by = {c: (p, new) for c, p, new in DELIVERY_RULES}
    same = lambda *names: [(c, *by[c]) for c in names]
    pairs = [r for r in DELIVERY_RULES if r[0] == "credential_value"]
    # The rules that this version has of its own, or has in another form.
    email = ("email", r"(?i)(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])", MASK)
    token = ("api_token", r"(?i)(?:sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{20,}|gh[pousr]_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})", MASK)
    meeting = ("meeting_url", r"(?i)(?<![A-Za-z0-9])(?:https?://)?(?:zoom\.us|meet\.google\.com|teams\.microsoft\.com|feishu\.cn)/[^\s\"<>]+", MASK)
    path = ("local_path", r"(?<![A-Za-z0-9])/(?:Users|home)/[^\s\"'<>\\]+", MASK)
    amount = ("payment_amount", r"(?i)(?<![A-Za-z0-9])(?:HK\$|RMB|[$¥￥])\s*[0-9]+(?:\.[0-9]{1,2})?(?![A-Za-z0-9])", MASK)
    identity = ("hkid", r"(?i)(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6}\([0-9A]\)(?![A-Za-z0-9])", MASK)
    host = ("user_at_host", r"(?<![A-Za-z0-9._%+-])[a-z][A-Za-z0-9._-]{1,31}@[A-Za-z][A-Za-z0-9._-]{1,63}(?![A-Za-z0-9._-])", MASK)
    titled = ("title_name", r"\b(?:Prof\.|Dr\.|Professor|Mr\.|Ms\.|Mrs\.)\s+(?!X\b|User\b|Person\b)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", MASK)
    labelled = ("name_label_value", r"((?:姓名|名字|联系人|收件人|发送者|用户名|账号名|用户名称)\s*[:：=]\s*)([^\s,;，；}]{1,40})", "$1" + MASK)
    chinese = ("cn_title_name", f"[{FAMILY_NAMES}](?:{NAME_TITLES})", MASK)
    places = [("institution", f"(?i){institution}", MASK)] if institution else []
    return [
        *pairs, email, token, *same("bearer_token", "credit_card"), meeting, *same("url"), path, amount, *same("license_plate", "phone_formatted", "phone_plain_hk", "phone_mobile"), identity,
        *same("participant_id", "anonymized_user"), host, *places, titled, chinese, labelled, *same("payment_merchant", "address_value"),
    ]


# Labels that look like a name before a colon or a verb but aren't one, and the start of another's SHA-256.
NON_PERSON = (
    "action", "ai", "ambient", "assistant", "caption", "densecaption", "details", "environment", "hkt", "model", "ocr", "scene", "screen",
    "self", "speech", "summary", "system", "text", "transcript", "user", "other", "others", "unknown", "male", "female", "man", "woman",
    "person", "speaker", "narrator", "student", "teacher", "me", "companion", "chinese", "friend", "colleague", "roommate", "passenger",
    "driver", "instructor", "lecturer", "caller", "gemini", "chatgpt", "claude", "deepseek", "whatsapp", "wechat", "telegram", "instagram",
    "messenger", "facebook", "youtube", "lite",
)
NON_PERSON_HASHES = ("5777ff8f6f1f",)
SPEAKER_PREFIX = r"(?<![A-Za-z])([A-Z][A-Za-z.'-]{1,30})(?=\s*[:：])"
ATTRIBUTED = r"(?<![A-Za-z])([A-Z][a-z][A-Za-z.'-]{0,29})(?=\s*(?:说|说道|表示|问|回答|告诉|喊|提到|建议|解释))"
ATTRIBUTED_ENGLISH = r"(?<![A-Za-z])([A-Z][a-z][A-Za-z.'-]{0,29})(?=\s+(?i:says|said|asks|asked|replies|replied|tells|told|speaks|spoke)\b)"


def unicode_pattern(pattern: str) -> str:
    """The pattern for Java with blanks, digits and word ends of all scripts, as Python has them."""
    return f"(?U){pattern}" if re.search(r"\\[sSdDwWb]", pattern) else pattern


def masked(df: DataFrame, text: str, rules: Sequence[tuple[str, str, str]] = DELIVERY_RULES) -> DataFrame:
    """The column masked, and a column ``hits``; each step is a projection of its own, so no rule runs twice."""
    names = []
    for k, (category, pattern, new) in enumerate(rules):
        pattern = unicode_pattern(pattern)
        names.append((category, f"hits_{k}"))
        df = df.withColumn(f"hits_{k}", F.regexp_count(F.col(text), F.lit(pattern))).withColumn(text, F.regexp_replace(text, pattern, new))
    hits = F.array(*[F.struct(F.lit(c).alias("category"), F.col(n).alias("n")) for c, n in names])
    # A generator is a barrier: a filter pushed below would put the steps into one another, twice each.
    others = [c for c in df.columns if c != text and c not in {n for _, n in names}]
    row = df.select(*others, F.explode(F.array(F.struct(F.col(text), F.filter(hits, lambda h: h["n"] > 0).alias("hits")))).alias("row"))
    return row.select(*others, "row.*")


def counted(df: DataFrame, text: str, categories: Sequence[tuple[str, str]]) -> DataFrame:
    """category, n: how often each pattern occurs in the column."""
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.regexp_count(F.col(text), F.lit(unicode_pattern(p))).alias("n")) for c, p in categories])
    return df.select(F.explode(entries).alias("e")).groupBy("e.category").agg(F.coalesce(F.sum("e.n"), F.lit(0)).cast("long").alias("n"))


def before_and_after(df: DataFrame, text: str, rules: Sequence[tuple[str, str, str]], categories: Sequence[tuple[str, str]]) -> DataFrame:
    """category, before, after: its hits in the texts and in the masked texts."""
    clean = masked(df, text, rules)
    return counted(df, text, categories).withColumnRenamed("n", "before").join(counted(clean, text, categories).withColumnRenamed("n", "after"), "category", "full").select("category", "before", "after")


def location_hash(rel: Column, line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", rel, line.cast("string")), 256), 1, 16)


def _located(df: DataFrame, rel: str, line: str) -> DataFrame:
    rows = df.select(rel, line, F.explode("hits").alias("h"))
    return rows.select(F.col("h.category").alias("category"), F.col("h.n").alias("n"), F.col(rel).alias("rel"), location_hash(F.col(rel), F.col(line)).alias("location"))


def audit(df: DataFrame, rel: str, line: str) -> DataFrame:
    """Per category: hits, files, and locations; ``audit_locations`` names these."""
    return _located(df, rel, line).groupBy("category").agg(F.sum("n").alias("n"), F.countDistinct("rel").alias("files"), F.countDistinct("location").alias("locations"))


def audit_locations(df: DataFrame, rel: str, line: str) -> DataFrame:
    """The distinct location hashes of each category, in order."""
    return _located(df, rel, line).select("category", "location").distinct().orderBy("category", "location")


def person_names(text: Column, speech: bool = False, explicit: Column | None = None) -> Column:
    """Names that a record signals: attributed speech, prefixes in speech, explicit fields."""
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in ((SPEAKER_PREFIX,) if speech else ()) + (ATTRIBUTED, ATTRIBUTED_ENGLISH)]
    if explicit is not None:
        found.append(F.array_compact(F.array(F.when(explicit.rlike(r"^[A-Za-z][A-Za-z .'-]{1,79}$"), explicit))))
    hashed = lambda n: F.substring(F.sha2(F.lower(n), 256), 1, 12).isin(*NON_PERSON_HASHES)
    return F.array_distinct(F.filter(F.concat(*found), lambda n: ~F.lower(n).isin(*NON_PERSON) & ~hashed(n)))


def longest_first(names: Column) -> Column:
    """Longest first, then by folded name, so that alternatives match the longest."""
    return F.transform(F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("l"), F.lower(n).alias("f"), n.alias("n")))), lambda s: s["n"])


def _letter_run(names: Column) -> Column:
    return F.lower(F.regexp_extract(names, "^[A-Za-z]+", 0))


def _names_pattern(names: Column) -> Column:
    return F.concat(F.lit(r"(?i)(?<![A-Za-z])(?:"), F.array_join(F.transform(longest_first(names), lambda n: F.regexp_replace(n, r"([.'-])", r"\\$1")), "|"), F.lit(r")(?![A-Za-z])"))


def corpus_names(df: DataFrame, text: str) -> DataFrame:
    """Column ``name``: the distinct names that speech is attributed to in any row; prefixes are too weak a sign for other rows."""
    return df.select(F.explode(person_names(F.col(text))).alias("name")).distinct()


def with_person_names(df: DataFrame, text: str, speech: bool = False) -> DataFrame:
    """A column ``names``: each row's own names, and those of the whole corpus that occur in it."""
    own = F.coalesce(person_names(F.col(text), speech), F.array().cast("array<string>"))
    return with_names(df.withColumn("names", own), text, corpus_names(df, text))


def with_names(df: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """Adds to the column ``names`` those of ``names`` (name) that occur in the text.

    A name that occurs begins with a whole run of letters of the text, so that run is the
    key by which texts and names meet. Texts are taken once each.
    """
    keyed = names.select("name", _letter_run(F.col("name")).alias("run"))
    digest = F.sha2(F.col(text), 256)
    runs = df.select(digest.alias("digest"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1))).alias("run")).distinct()
    met = runs.join(keyed, "run").groupBy("digest").agg(F.sort_array(F.collect_set("name")).alias("met"))
    rows = df.withColumn("digest", digest).join(met, "digest", "left")
    occurs = F.filter(F.coalesce("met", F.array().cast("array<string>")), lambda n: F.regexp_like(F.col(text), _names_pattern(F.array(n))))
    return rows.select(*[c for c in df.columns if c != "names"], F.array_union("names", occurs).alias("names"))


def mask_names(text: Column, names: Column) -> Column:
    """The given names masked, at letter boundaries, case-insensitively."""
    return F.when(F.size(names) > 0, F.regexp_replace(text, _names_pattern(names), F.lit(MASK))).otherwise(text)


def names_hits(text: Column, names: Column) -> Column:
    return F.when(F.size(names) > 0, F.regexp_count(text, _names_pattern(names))).otherwise(0)


def clip_blocks(lines: DataFrame, by: Sequence[str], order: str, line: str, kept: DataFrame | None = None, clip: str = "clip_id") -> DataFrame:
    """Lines without blanks at their ends, of all blocks but those of `===== clip N` whose clip isn't kept or that are empty.

    Lines before the first header, and blocks with a header of another form, stay. ``kept`` has the columns ``by`` and ``clip``.
    """
    w = Window.partitionBy(*by)
    before = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    heads = F.startswith(F.col(line), F.lit("===== clip"))
    tagged = lines.withColumn("_block", F.sum(heads.cast("int")).over(before))
    own = Window.partitionBy(*by, "_block")
    number = F.when(heads, F.nullif(F.regexp_extract(line, r"^===== clip\s+(\d+)\b", 1), F.lit("")).cast("long"))
    tagged = tagged.withColumn(clip, F.max(number).over(own)).withColumn("_solid", F.max(~heads & (strip(F.col(line)) != "")).over(own))
    if kept is not None:
        tagged = tagged.join(kept.select(*by, clip).distinct().withColumn("_kept", F.lit(True)), [*by, clip], "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    else:
        tagged = tagged.withColumn("_kept", F.lit(True))
    fine = tagged.filter(F.col(clip).isNull() | (F.col("_kept") & F.col("_solid")))
    return fine.withColumn(line, F.regexp_replace(line, r"(?U)\s+$", "")).select(*lines.columns, clip)


def trimmed_end(lines: DataFrame, by: Sequence[str], order: str, line: str) -> DataFrame:
    """Lines of each file without the blank ones at its end."""
    last = F.max(F.when(F.col(line) != "", F.col(order))).over(Window.partitionBy(*by))
    return lines.withColumn("_last", last).filter(F.col(order) <= F.col("_last")).drop("_last")
