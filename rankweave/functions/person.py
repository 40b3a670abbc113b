"""Whether a text can be a person's name or a place, how good a name is, and how to write it. All are column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import CITY_STATE, EMAIL, LOCATION, PHONE, PLACE_WORDS, PLACED

# Words of file names, of prose, of places and of technology, skills, and what marks a line as no name.
NOISE = [
    "resume", "resumes", "cv", "cvs", "biodata", "bio", "data", "doc", "docs", "document", "documents", "file", "files", "copy", "final", "updated", "latest", "new", "old", "draft",
    "scan", "scanned", "pdf", "docx", "naukri", "linkedin", "indeed", "monster", "shine", "foundit", "portal", "download", "attachment", "untitled", "unknown", "candidate", "profile",
    "my", "the", "and", "of", "for", "to", "v1", "v2", "v3", "ver", "version", "info", "details", "application", "appl", "soft", "hard",
]
PROSE = [
    "my", "our", "the", "a", "an", "and", "or", "but", "with", "from", "for", "to", "of", "in", "on", "at", "by", "as", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "can", "include", "includes", "including", "having", "using", "used", "working", "worked", "work", "experience", "experienced", "years",
    "year", "skills", "skill", "knowledge", "proficient", "strong", "hands", "hand", "off", "novelties", "novelty", "interested", "looking", "seeking", "available", "immediate", "currently", "current",
    "responsible", "responsibilities", "developed", "designed", "created", "built", "managed", "led", "team", "project", "projects", "about", "me", "objective", "summary", "profile", "contact", "phone", "email",
    "mobile", "address", "location", "info", "information", "details", "this", "that", "these", "those", "their", "his", "her", "its", "also", "etc", "via", "per", "into", "over", "under", "above",
    "some", "any", "all", "body", "text", "page", "pages", "section", "software", "hardware", "system", "systems", "role", "roles", "position", "company", "organization", "university", "college",
    "school", "fresher", "graduate", "professional", "personal",
]
PLACES = [
    "based", "in", "at", "near", "from", "of", "the", "and", "ncr", "delhi", "noida", "gurgaon", "gurugram", "ghaziabad", "indirapuram", "bangalore", "bengaluru", "hyderabad", "chennai", "mumbai", "pune",
    "kolkata", "india", "remote", "onsite", "location", "address", "area", "sector", "street", "road", "city", "state", "country", "pin", "zip",
]
TECHNOLOGY = [
    "database", "mongodb", "nosql", "mysql", "postgres", "postgresql", "redis", "sql", "sqlite", "oracle", "dynamodb", "cassandra", "javascript", "typescript", "python", "java", "golang", "rust", "kotlin",
    "html", "css", "react", "angular", "vue", "node", "nodejs", "express", "nextjs", "next", "django", "flask", "fastapi", "spring", "docker", "kubernetes", "k8s", "aws", "azure", "gcp", "linux", "git",
    "ci", "cd", "api", "rest", "graphql", "microservices", "backend", "frontend", "fullstack", "devops", "ml", "ai", "nlp", "tensorflow", "pytorch", "pandas", "numpy", "bootstrap", "tailwind", "sass",
    "jquery", "redux", "mongoose", "prisma", "firebase", "hadoop", "spark", "kafka", "rabbitmq", "nginx", "apache", "c", "cpp", "csharp", "php", "ruby", "swift", "scala", "r",
    "skills", "technologies", "tools", "frameworks", "libraries", "programming", "languages", "technical", "proficient", "expertise",
]
SKILLS = [
    "Python", "Java", "JavaScript", "TypeScript", "Go", "Golang", "Rust", "C++", "C#", "Ruby", "PHP", "Swift", "Kotlin", "Scala", "R", "MATLAB", "SQL", "Bash", "Shell",
    "React", "Angular", "Vue", "Node.js", "NodeJS", "Express", "Django", "Flask", "FastAPI", "Spring", "Spring Boot", "ASP.NET", ".NET", "Next.js", "GraphQL", "REST", "gRPC", "HTML", "CSS", "Svelte",
    "pandas", "NumPy", "scikit-learn", "TensorFlow", "PyTorch", "Keras", "Spark", "Hadoop", "Airflow", "dbt", "Tableau", "Power BI", "Kafka", "ETL", "Machine Learning", "Deep Learning", "NLP", "Computer Vision",
    "AWS", "Azure", "GCP", "Google Cloud", "Docker", "Kubernetes", "K8s", "Terraform", "Ansible", "Jenkins", "CI/CD", "GitHub Actions", "GitLab CI", "Linux", "Prometheus", "Grafana", "Helm", "Lambda", "EC2", "S3",
    "CloudFormation", "Pulumi", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Elasticsearch", "DynamoDB", "Cassandra", "Oracle", "SQL Server", "SQLite", "Neo4j",
    "Agile", "Scrum", "leadership", "mentoring", "system design", "microservices", "TDD", "Jira",
]
NO_NAME = (
    r"(?i)\b(based\s+in|located\s+in|residing\s+in|lives?\s+in|live\s+in|address|current\s+location|location\s*:|relocat|open\s+to\s+work|seeking|looking\s+for|available\s+for|"
    r"phone|mobile|email|linkedin|github|http|www\.|resume|curriculum|vitae|\bcv\b|objective|summary|profile|contact|experience|education|skills|certification|project|technologies|"
    r"engineer|developer|student|intern|bachelor|master|b\.?tech|database|mongodb|nosql|mysql|postgres|redis|sql|html|css|javascript|typescript|python|java|react|node|express|docker|"
    r"kubernetes|aws|azure|gcp|fullstack|full\s*stack|backend|frontend|novelties|include|hands[\s\-]?on|proficient|responsible|interested|passionate|motivated|dedicated|results?\s*driven)\b"
)


def _by_first(pattern: str) -> str:
    """NO_NAME with its alternatives gathered by their first letter: fits the same texts, with fewer trials at each word."""
    groups: dict[str, list[str]] = {}
    for x in pattern.removeprefix(r"(?i)\b(").removesuffix(r")\b").split("|"):
        x = x.removeprefix(r"\b")
        groups.setdefault(x[0], []).append(x[1:])
    return r"(?i)\b(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in groups.items()) + r")\b"


_NO_NAME = _by_first(NO_NAME)
OPENERS = ["my", "our", "the", "a", "an", "this", "his", "her"]
#: Trust in a single source of a name.
TRUST = {"filename": 78, "email": 72, "llm": 68, "heuristic": 48}

#: What a file's name may hold beside a person's, and what takes its place.
FILE_PARTS = [
    (r"(?i)\.(pdf|docx?|txt|rtf)$", ""),
    (r"[\[(].*?[\])]", " "),
    (r"(?i)^(?:(?:naukri|linkedin|indeed|monster|shine|foundit|resume|cv|biodata|doc|document|file|copy|my|the)[\s_.\-]+){1,3}", ""),
    (r"(?i)[_\-\s]+\d+\s*[ym](?:ear|r|onth|o)?s?\b.*$", " "),
    (r"(?i)[_\-\s]+exp(?:erience)?.*$", " "),
    (r"(?i)[_\-\s]+v\d+\b.*$", " "),
    (r"\d+", " "),
]

TECH_KEYS = sorted({re.sub("[^a-z0-9]", "", w.lower()) for w in TECHNOLOGY + SKILLS})


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often the expression names it."""
    return F.transform(F.array(value), use)[0]


def name_words(text: Column) -> Column:
    return _found(text, r"[A-Za-z][A-Za-z\-']+")


def _count(words: Column, test) -> Column:
    return F.size(F.filter(words, test))


def by_length(words: list[str]) -> list[str]:
    """Words as one text for each length from 0 up, each word between bars; an empty one at the end for longer ones."""
    return ["".join(f"|{w}" for w in words if len(w) == n) + "|" for n in range(max(map(len, words)) + 1)] + [""]


def among(word: Column, words: list[str]) -> Column:
    """Whether a word is one of these. It is looked for among those of its length only; the list is one literal, which keeps plans small."""
    lists = by_length(words)
    some = F.split(F.lit("\n".join(lists)), "\n", -1)
    return bound(word, lambda w: F.contains(F.get(some, F.least(F.length(w), F.lit(len(lists) - 1))), F.concat(F.lit("|"), w, F.lit("|"))))


def is_tech(word: Column) -> Column:
    return among(F.regexp_replace(F.lower(word), "[^a-z0-9]", ""), TECH_KEYS)


def tech_blob(text: Column) -> Column:
    """Whether a text is technologies: two of them, or one among at most two words."""
    words = _found(text, r"[A-Za-z][A-Za-z0-9+.#\-']*")
    both = bound(words, lambda w: F.struct(F.size(w).alias("n"), _count(w, is_tech).alias("hits")))
    return bound(both, lambda b: (b["hits"] >= 2) | ((b["hits"] == 1) & (b["n"] <= 2)))


def prose(name: Column) -> Column:
    """Whether a would-be name reads like part of a sentence, or holds no word."""
    return bound(F.transform(_found(name, r"[A-Za-z][A-Za-z\-']*"), lambda w: F.regexp_replace(F.lower(w), "^[-']+|[-']+$", "")), _prose_words)


def _prose_words(words: Column) -> Column:
    n = F.size(words)
    verbal = F.exists(words, lambda w: w.rlike("(?:ing|ed|ly)$") & ~w.isin("king", "young"))
    long, opened = n >= 3, F.coalesce(among(F.try_element_at(words, F.lit(1)), OPENERS), F.lit(False))
    return bound(_count(words, lambda w: among(w, PROSE)), lambda hits: (n == 0) | (hits >= 2) | ((hits >= 1) & long) | opened | ((long | (hits >= 1)) & verbal))


def without_noise(text: Column) -> Column:
    """The words of a name-like text that are none of file names; empty if none is left."""
    kept = F.filter(_found(text, r"[A-Za-z][A-Za-z\-']*"), lambda w: ~among(F.regexp_replace(F.lower(w), "^[-']+|[-']+$", ""), NOISE))
    return F.array_join(kept, " ")


def cased(name: Column) -> Column:
    """Words that are all capitals or all small letters with a capital after every non-letter; others as they are."""

    def word(w: Column) -> Column:
        plain = F.array_join(F.transform(_found(w, "[A-Za-z]+|[^A-Za-z]+"), F.initcap), "")
        return F.when((w == F.upper(w)) | (w == F.lower(w)), plain).otherwise(w)

    return F.array_join(F.transform(F.split(name, " "), word), " ")


def titled(name: Column) -> Column:
    """A capital after every non-letter, small letters elsewhere."""
    return F.array_join(F.transform(_found(name, "[A-Za-z]+|[^A-Za-z]+"), F.initcap), "")


def _parted(word: Column) -> Column:
    return F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2")


def name_of_file(filename: Column) -> Column:
    """The name that a file's name holds, null if none: portals' prefixes, brackets, years, versions, numbers and noise words go first."""
    stem = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    for pattern, by in FILE_PARTS:
        stem = F.regexp_replace(stem, pattern, by)
    bare = F.trim(F.regexp_replace(stem, r"[\s_.\-]+", " "))
    words = bound(bare, lambda b: F.when(F.length(b) >= 3, F.filter(_found(b, "[A-Za-z][A-Za-z']+"), lambda w: ~among(F.lower(w), NOISE))))

    def alone(word: Column) -> Column:
        whole = bound(titled(word), lambda w: F.when(~is_tech(w) & ~among(F.lower(w), PROSE) & plausible_person(w, single=True), w))
        return F.coalesce(bound(cased(_parted(word)), lambda p: F.when(p.contains(" ") & plausible_person(p), p)), whole)

    def together(words: Column) -> Column:
        no_junk = lambda name: ~tech_blob(name) & ~prose(name) & ~F.exists(words, lambda w: is_tech(w) | among(F.lower(w), PROSE))
        return bound(cased(F.array_join(words, " ")), lambda name: F.when(plausible_person(name) | no_junk(name), name))

    return bound(words, lambda w: F.when((F.size(w) == 1) & (F.length(w[0]) >= 6), alone(w[0])).when(F.size(w).between(2, 4), together(w)))


def name_of_mail(email: Column) -> Column:
    """The name that the part of an address before its @ holds, null if none."""
    local = F.when(email.contains("@"), F.regexp_replace(F.split_part(email, F.lit("@"), F.lit(1)), r"[0-9._+\-]+", " "))
    words = F.filter(F.split(F.trim(local), r"\s+"), lambda w: w.rlike(r"^\p{L}{2,}$"))

    def alone(word: Column) -> Column:
        return F.coalesce(bound(F.initcap(_parted(word)), lambda p: F.when(p.contains(" ") & plausible_person(p), p)), F.initcap(word))

    def together(words: Column) -> Column:
        return bound(F.array_join(F.transform(F.slice(words, 1, 4), F.initcap), " "), lambda name: F.when(plausible_person(name) | ~tech_blob(name), name))

    return bound(words, lambda w: F.when(F.size(w) >= 2, together(w)).when((F.size(w) == 1) & (F.length(w[0]) >= 5) & ~is_tech(w[0]), alone(w[0])))


def plausible_person(name: Column, single: bool = False) -> Column:
    """Whether a text can be a name of two to four words, or one word of five letters or more where single is set."""
    trimmed = F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")
    forms = bound(trimmed, lambda t: F.struct(F.length(t).between(3, 80).alias("sized"), bound(without_noise(t), lambda w: F.when(w == "", t).otherwise(w)).alias("bare")))
    return bound(forms, lambda f: f["sized"] & ~f["bare"].rlike(_NO_NAME) & ~tech_blob(f["bare"]) & ~prose(f["bare"]) & bound(name_words(f["bare"]), lambda words: _person_words(words, single)))


def _person_words(words: Column, single: bool) -> Column:
    n = F.size(words)
    bad = F.exists(words, lambda w: is_tech(w) | among(F.lower(w), NOISE) | among(F.lower(w), PROSE))
    places = _count(words, lambda w: among(F.lower(w), PLACES))
    several = n.between(2, 4) & (places <= 1) & (n - places >= 2) & F.exists(words, lambda w: w.rlike("^[A-Z]"))
    first = F.try_element_at(words, F.lit(1))
    alone = (n == 1) & (F.length(first) >= 5) & (places == 0) & ~((first == F.upper(first)) & (F.length(first) <= 5))
    return ~bad & F.coalesce((several | alone) if single else several, F.lit(False))


def only(rows: DataFrame, condition: Column, *columns) -> DataFrame:
    """These columns of the rows for which the condition holds. Unlike where(), it isn't moved below the projections that make its columns, which would write out their expressions wherever it names them. The outer form keeps a filter from being inferred that is."""
    return rows.select(F.inline_outer(F.when(condition, F.array(F.struct(F.lit(True).alias("_kept"), *columns))))).where("_kept").drop("_kept")


def no_name(text: Column) -> Column:
    """Whether a text holds what marks a line as no name."""
    return text.rlike(_NO_NAME)


def tested(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """What is asked about would-be names. column: a list of struct(name, keep); each entry gets fits, fits_alone, tech and wordy.

    fits and fits_alone: plausible_person() without and with single words; tech: tech_blob(); wordy: prose(). Each step is a
    projection of its own, so that nothing is computed twice, and written as SQL, which is a good deal faster to plan than column
    objects. What is asked of a name's words is asked again of those without noise only where there is noise.
    """
    found = lambda c, pattern: f"""regexp_extract_all({c}, r"({pattern})", 1)"""
    word, long, token = r"[A-Za-z][A-Za-z\-']*", r"[A-Za-z][A-Za-z\-']+", r"[A-Za-z][A-Za-z0-9+.#\-']*"
    low = lambda c: f"""transform({c}, w -> regexp_replace(lower(w), r"^[-']+|[-']+$", ''))"""
    plain = lambda c: f"transform({c}, w -> regexp_replace(lower(w), '[^a-z0-9]', ''))"

    def within(w: str, words: list[str]) -> str:
        lists = by_length(words)
        return f"contains(get(split('{';'.join(lists)}', ';', -1), least(length({w}), {len(lists) - 1})), concat('|', {w}, '|'))"

    hits = lambda c, words: f"size(filter({c}, w -> {within('w', words)}))"
    verbal = lambda c: f"exists({c}, w -> w RLIKE '(?:ing|ed|ly)$' AND w NOT IN ('king', 'young'))"
    opens = lambda c: f"coalesce({within(f'try_element_at({c}, 1)', OPENERS)}, false)"
    wordy = lambda c, n: f"(size({c}) = 0 OR {n} >= 2 OR ({n} >= 1 AND size({c}) >= 3) OR {opens(c)} OR ((size({c}) >= 3 OR {n} >= 1) AND {verbal(c)}))"
    again = lambda c, otherwise: f"if(x.same, {c}, {otherwise})"
    first = "try_element_at(x.words, 1)"
    steps = [
        {"text": "coalesce(x.name, '')"},
        {"trimmed": r"""regexp_replace(x.text, r"^\s+|\s+$", '')""", "every": found("x.text", word), "tokens": found("x.text", token)},
        {"lows": low("x.every"), "n_tech": hits(plain("x.tokens"), TECH_KEYS)},
        {"kept": f"array_join(filter(x.every, (w, i) -> NOT {within('get(x.lows, i)', NOISE)}), ' ')", "n_prose": hits("x.lows", PROSE), "tech": "x.n_tech >= 2 OR (size(x.tokens) <= 2 AND x.n_tech >= 1)"},
        {"bare": "coalesce(nullif(x.kept, ''), x.trimmed)", "wordy": wordy("x.lows", "x.n_prose")},
        {"same": "x.bare = x.text", "words": found("x.bare", long)},
        {"lows": again("x.lows", low(found("x.bare", word))), "tokens": again("x.tokens", found("x.bare", token)), "places": hits("transform(x.words, w -> lower(w))", PLACES), "n": "size(x.words)"},
        {"n_tech": again("x.n_tech", hits(plain("x.tokens"), TECH_KEYS)), "n_prose": again("x.n_prose", hits("x.lows", PROSE))},
        {
            "several": "x.n BETWEEN 2 AND 4 AND x.places <= 1 AND x.n - x.places >= 2 AND exists(x.words, w -> w RLIKE '^[A-Z]')",
            "one": f"coalesce(x.n = 1 AND length({first}) >= 5 AND x.places = 0 AND NOT ({first} = upper({first}) AND length({first}) <= 5), false)",
            "blob": "x.n_tech >= 2 OR (size(x.tokens) <= 2 AND x.n_tech >= 1)",
        },
        {
            "usable": f"""(x.several OR x.one) AND length(x.trimmed) BETWEEN 3 AND 80 AND NOT x.blob AND NOT {again("x.wordy", wordy("x.lows", "x.n_prose"))}
                AND NOT exists(transform(x.words, w -> lower(w)), w -> {within("w", NOISE)} OR {within("w", PROSE)}) AND NOT exists({plain("x.words")}, w -> {within("w", TECH_KEYS)}) AND NOT x.bare RLIKE r'{_NO_NAME}'""",
        },
        {"fits": "x.usable AND x.several", "fits_alone": "x.usable"},
    ]
    out, fields = rows, ["name", *keep]
    for step in steps:
        fields = [*dict.fromkeys([*fields, *step])]
        made = ", ".join(f"'{c}', {step.get(c, f'x.{c}')}" for c in fields)
        out = out.withColumn(column, F.expr(f"transform({column}, x -> named_struct({made}))"))
    last = ["name", *keep, "fits", "fits_alone", "tech", "wordy"]
    return out.withColumn(column, F.expr(f"transform({column}, x -> named_struct({', '.join(f"'{c}', x.{c}" for c in last)}))"))


def plausible_place(place: Column) -> Column:
    """Whether a text can be a place: 2 to 120 characters, no technologies, no address of mail, no phone number."""
    raw = F.regexp_replace(F.coalesce(place, F.lit("")), r"^\s+|\s+$", "")
    phone = raw.rlike(PHONE) & (F.length(F.regexp_replace(raw, "[^0-9]", "")) >= 10)
    words = _found(raw, "[A-Za-z]+")
    all_tech = (F.size(words) > 0) & F.forall(words, is_tech)
    return F.length(raw).between(2, 120) & ~tech_blob(raw) & ~raw.rlike(EMAIL) & ~phone & ~all_tech


def place_of(header: Column, full: Column) -> Column:
    """The place after a word for it, in the header or else anywhere; else the first of the header's lines with "City, State" or such a word. Null if none is plausible."""
    fit = lambda c: bound(c, lambda x: F.when(plausible_place(x), x))
    ends = lambda c, marks: F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")
    said = F.when(header.rlike(LOCATION), F.regexp_extract(header, LOCATION, 1)).otherwise(F.regexp_extract(full, LOCATION, 1))

    def of_line(line: Column) -> Column:
        off = tech_blob(line) | (line.rlike(_NO_NAME) & ~line.rlike(PLACE_WORDS))
        city = F.when(line.rlike(CITY_STATE), F.concat_ws(", ", F.regexp_extract(line, CITY_STATE, 1), F.regexp_extract(line, CITY_STATE, 2)))
        return F.when(~off, F.coalesce(fit(city), fit(F.when(line.rlike(PLACED), ends(F.regexp_extract(line, PLACED, 1), " .,|-")))))

    by_line = F.array_compact(F.transform(F.slice(F.split(header, "\n"), 1, 12), of_line))
    return F.coalesce(fit(ends(said, " .,-")), F.try_element_at(by_line, F.lit(1)))


def name_quality(name: Column, source: Column) -> Column:
    """How well a name is fit to be shown, by its sources (joined by a plus sign), number of words, casing and signs of prose or file names."""
    words, parts = name_words(name), F.split(source, r"\+")
    n = F.size(words)
    trust = F.array_max(F.transform(parts, lambda s: reduce(lambda out, kv: F.when(s == kv[0], kv[1]).otherwise(out), TRUST.items(), F.lit(40))))
    length = F.when(n == 2, 8).when(n == 3, 4).when(n == 1, -12).when(n >= 4, -10).otherwise(0)
    bonus = lambda c, v: F.when(c, v).otherwise(0)
    extra = [bonus(F.size(parts) >= 2, 18), bonus((n > 0) & F.forall(words, lambda w: w.rlike("^[A-Z]")), 4), bonus(prose(name), -40), bonus(F.exists(words, lambda w: among(F.lower(w), NOISE)), -30)]
    return trust + length + sum(extra, F.lit(0))
