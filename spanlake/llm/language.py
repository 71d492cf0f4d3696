"""Language of documents by Bayesian fusion of evidence.

Four sources meet in one posterior: the text's likelihood under hashed character trigrams of each language, the declared
markup language, the suffix of the address, and a prior of the host, whose language counts are shrunk towards its
domain's and these towards the corpus's.  The languages are those that enough rows declare, whichever they are; beside them
stands a background that draws trigrams at random, for texts that no language explains.  All trigrams of a text are read; their mean
log probability counts as that of ``EVIDENCE_GRAMS`` trigrams at most, as neighbouring trigrams don't speak independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import bind
from spanlake.llm.common import SPACES, keep_rows, python_ready, row_key, stored
from spanlake.llm.pieces import CACHE
from spanlake.llm.quality_classifier import words
from spanlake.operators.staging import once

#: Languages if no row declares one; the name of a text that is in none.
LANGUAGES, NONE = ("en", "de", "fr", "es"), "und"
#: Texts that must declare a language for it to have a model, and languages with a model at most (the most frequent; ISO 639-1 has 184).
MIN_TEXTS, MAX_LANGUAGES = 3, 512
#: Hash buckets of the trigrams, pseudo-count of each; trigrams that a text counts for at most.
BUCKETS, SMOOTHING, EVIDENCE_GRAMS = 8192, 0.5, 60
#: Bytes of a worker's table of word sums.
TABLE_BYTES = 128 << 20
#: Probability that a declared language, and the language of an address suffix, is the text's.
DECLARED_TRUST, SUFFIX_TRUST = 0.9, 0.7
#: Probability that a text is in none of the languages, before it is read.
NONE_PRIOR = 0.05
#: Documents that the level above counts for: corpus behind a domain, domain behind a host.
DOMAIN_STRENGTH, HOST_STRENGTH = 50.0, 20.0
#: Posterior of the best language from which a document is kept.
MIN_CONFIDENCE = 0.6

# Countries whose addresses speak for one language.
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es",
    "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "gov": "en", "edu": "en",
    "it": "it", "pl": "pl", "ru": "ru", "tr": "tr", "cn": "zh", "tw": "zh", "jp": "ja", "kr": "ko", "nl": "nl", "pt": "pt", "br": "pt", "se": "sv",
    "no": "no", "dk": "da", "fi": "fi", "cz": "cs", "sk": "sk", "hu": "hu", "ro": "ro", "bg": "bg", "gr": "el", "ua": "uk", "ee": "et", "lv": "lv",
    "lt": "lt", "hr": "hr", "si": "sl", "rs": "sr", "is": "is", "ir": "fa", "vn": "vi", "th": "th",
}

# Other spellings of a language's subtag (ISO 639-2 for its two letters; names that occur in markup).
SUBTAGS = {other: code for code, *others in (x.split() for x in """
    aa aar,ab abk,ae ave,af afr,ak aka,am amh,an arg,ar ara,as asm,av ava,ay aym,az aze,ba bak,be bel,bg bul,bi bis,bm bam,bn ben,bo bod tib,br bre,bs bos,
    ca cat,ce che,ch cha,co cos,cr cre,cs ces cze,cu chu,cv chv,cy cym wel,da dan,de deu ger german deutsch,dv div,dz dzo,ee ewe,el ell gre,en eng english,
    eo epo,es spa spanish español,et est,eu eus baq,fa fas per,ff ful,fi fin,fj fij,fo fao,fr fra fre french français,fy fry,ga gle,gd gla,gl glg,gn grn,gu guj,
    gv glv,ha hau,he heb iw,hi hin,ho hmo,hr hrv,ht hat,hu hun,hy hye arm,hz her,ia ina,id ind in,ie ile,ig ibo,ii iii,ik ipk,io ido,is isl ice,it ita,iu iku,
    ja jpn,jv jav,ka kat geo,kg kon,ki kik,kj kua,kk kaz,kl kal,km khm,kn kan,ko kor,kr kau,ks kas,ku kur,kv kom,kw cor,ky kir,la lat,lb ltz,lg lug,li lim,
    ln lin,lo lao,lt lit,lu lub,lv lav,mg mlg,mh mah,mi mri mao,mk mkd mac,ml mal,mn mon,mr mar,ms msa may,mt mlt,my mya bur,na nau,nb nob,nd nde,ne nep,
    ng ndo,nl nld dut,nn nno,no nor,nr nbl,nv nav,ny nya,oc oci,oj oji,om orm,or ori,os oss,pa pan,pi pli,pl pol,ps pus,pt por,qu que,rm roh,rn run,
    ro ron rum,ru rus,rw kin,sa san,sc srd,sd snd,se sme,sg sag,si sin,sk slk slo,sl slv,sm smo,sn sna,so som,sq sqi alb,sr srp,ss ssw,st sot,su sun,sv swe,
    sw swa,ta tam,te tel,tg tgk,th tha,ti tir,tk tuk,tl tgl,tn tsn,to ton,tr tur,ts tso,tt tat,tw twi,ty tah,ug uig,uk ukr,ur urd,uz uzb,ve ven,vi vie,vo vol,
    wa wln,wo wol,xh xho,yi yid ji,yo yor,za zha,zh zho chi,zu zul""".split(",")) for other in others}
#: Subtags that name no language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "nil")


def trigram_buckets(found: list[str], buckets: int = BUCKETS):
    """(buckets, starts, inside): the trigrams of words in lower case, their ends included, one word after the other.

    ``starts`` has the first trigram of each word; ``inside`` is 0 for the trigrams that reach over two words.
    """
    import numpy as np
    codes = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate(([0], (lengths + 1).cumsum()[:-1]))
    inside = np.ones(len(mixed), np.int64)
    inside[(starts + lengths)[:-1]] = 0
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), starts, inside


class WordTable:
    """Sums over the trigrams of words: a row per word met lately, one column per language and the number of trigrams."""

    def __init__(self, logs):
        import numpy as np
        self.np, self.logs = np, np.array(logs, float)
        self.places: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.logs) + 1))
        self.most = min(CACHE, TABLE_BYTES // (8 * (len(self.logs) + 1)))

    def total(self, found: list[str]):
        """The sum of the rows of a text's words; a very long text goes in slices."""
        np, step = self.np, min(100_000, self.most)
        if len(found) > step:
            return sum(self.total(found[at:at + step]) for at in range(0, len(found), step))
        if len(self.places) > self.most:
            self.places.clear()
        new = [w for w in dict.fromkeys(found) if w not in self.places]
        if new:
            buckets, starts, inside = trigram_buckets(new, self.logs.shape[1])
            first = len(self.places)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[first:first + len(new), :-1] = np.add.reduceat(self.logs[:, buckets] * inside, starts, axis=1).T
            self.rows[first:first + len(new), -1] = np.add.reduceat(inside, starts)
            self.places.update(zip(new, range(first, first + len(new))))
        return self.rows[np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))].sum(axis=0)


def fit_trigrams(docs: DataFrame, declared: Column, languages: tuple[str, ...] = LANGUAGES, buckets: int = BUCKETS, text_col: str = "text"):
    """Log probability of every bucket (columns) in every language (rows), from all texts that declare one of ``languages``.

    Counts are added up in the tasks; languages times ``buckets`` numbers come back to the driver, 12 MB for the 184 languages of ISO 639-1.
    """
    python_ready(docs.sparkSession)
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        sums = np.zeros((len(number), buckets), np.int64)
        met: list[Counter] = [Counter() for _ in number]

        def add(lang: int) -> None:
            if met[lang]:
                at, starts, inside = trigram_buckets(list(met[lang]), buckets)
                times = np.repeat(np.fromiter(met[lang].values(), np.int64), np.diff(np.append(starts, len(at))))
                sums[lang] += np.bincount(at, times * inside, buckets).astype(np.int64)
                met[lang].clear()

        with np.errstate(over="ignore"):
            for batch in batches:
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                    met[number[lang]].update(words(text.lower()))
                    if len(met[number[lang]]) > CACHE:
                        add(number[lang])
            for lang in range(len(number)):
                add(lang)
        lang, bucket = sums.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[lang, bucket], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text"), declared.alias("lang")).filter(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    counts = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages times buckets at most
    import numpy as np
    sums = np.zeros((len(languages), buckets))
    sums[counts["lang"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return np.log(sums + SMOOTHING) - np.log((sums + SMOOTHING).sum(axis=1, keepdims=True))


def declared_language(says: Column) -> Column:
    """The language that a declaration names: its whole first subtag (``en`` of ``en-GB`` and ``eng``, ``et`` of ``est``); NULL if it names none."""
    first = F.nullif(F.regexp_extract(F.lower(F.trim(says)), r"^(\p{L}+)(?:[-_.@].*)?$", 1), F.lit(""))
    known = F.coalesce(F.create_map(*[F.lit(x) for kv in SUBTAGS.items() for x in kv])[first], first)
    return F.when(known.rlike("^[a-z]{2,3}$") & ~known.isin(*NO_LANGUAGE), known)


def declared_languages(docs: DataFrame, declared: Column, text_col: str = "text", min_texts: int = MIN_TEXTS, most: int = MAX_LANGUAGES) -> tuple[str, ...]:
    """The languages that ``min_texts`` rows with a text declare, the most frequent first (ties by name), ``most`` at most.

    Other declarations say nothing: a model of a few texts, or of a misspelt subtag, would take texts from its neighbours.
    """
    found = docs.select(declared.alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & (F.trim("text", F.lit(SPACES)) != ""))
    counts = found.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= min_texts)
    return tuple(r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(most).collect()) or LANGUAGES


def text_likelihood(rows: DataFrame, model, text_col: str = "_text", cap: int = EVIDENCE_GRAMS) -> DataFrame:
    """``rows`` without the text, with ``n_words`` and ``likelihood`` (log, one per language, then that of buckets drawn at random)."""
    import numpy as np
    python_ready(rows.sparkSession)
    logs = rows.sparkSession.sparkContext.broadcast(np.asarray(model, np.float32))  # MAX_LANGUAGES times BUCKETS times 4 bytes: 16 MB at most

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa
        table = WordTable(logs.value)
        none, random = np.zeros(len(table.logs) + 1), -np.log(table.logs.shape[1])
        for batch in batches:
            n, likelihood = [], []
            for text in batch.column(text_col).to_pylist():
                found = words((text or "").lower())
                n.append(len(found))
                total = table.total(found) if found else none
                likelihood.append((np.append(total[:-1] / total[-1], random) * min(total[-1], cap) if found else none).tolist())
            kept = [(batch.column(i), name) for i, name in enumerate(batch.schema.names) if name != text_col]
            yield pa.RecordBatch.from_arrays([c for c, _ in kept] + [pa.array(n, pa.int64()), pa.array(likelihood, pa.list_(pa.float64()))],
                                             names=[name for _, name in kept] + ["n_words", "likelihood"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text_col)
    return rows.mapInArrow(score, f"{kinds}, n_words long, likelihood array<double>")


def posterior(logs: Column) -> Column:
    """Probabilities from an array of log weights."""
    return bind(F.array_max(logs), lambda most: bind(F.transform(logs, lambda x: F.exp(x - most)), lambda weights: bind(
        F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(weights, lambda w: w / total))))


def _array_of(languages: int, column: str) -> Column:
    """The values of groups of (i, value) rows as an array; a language that is missing has 0."""
    pairs = F.map_from_entries(F.collect_list(F.struct("i", column)))  # one entry a language
    return bind(pairs, lambda m: F.transform(F.sequence(F.lit(0), F.lit(languages - 1)), lambda i: F.coalesce(m[i], F.lit(0.0))))


def host_priors(scored: DataFrame, languages: tuple[str, ...], domain_strength: float = DOMAIN_STRENGTH, host_strength: float = HOST_STRENGTH) -> DataFrame:
    """(_host, prior): language shares of each host, shrunk to its domain's, these to the corpus's; sums over all documents.

    A document counts as far as it is in a language at all.  Hosts without any text have the corpus's shares."""
    n = len(languages)
    soft = scored.filter("n_words > 0").select("host", posterior(F.col("likelihood")).alias("p"))
    parts = soft.select("host", F.posexplode("p").alias("i", "v")).filter(F.col("i") < n).groupBy("host", "i").agg(F.sum("v").alias("v"))
    hosts = stored(parts.withColumn("domain", domain_of(F.col("host"))), "host-sums")
    of_domains = stored(hosts.groupBy("domain", "i").agg(F.sum("v").alias("v")), "domain-sums")
    found = {r["i"]: r["v"] for r in of_domains.groupBy("i").agg(F.sum("v").alias("v")).collect()}  # one number a language
    sums = [found.get(i, 0.0) + 1.0 for i in range(n)]
    corpus = F.split(F.lit(",".join(repr(s / sum(sums)) for s in sums)), ",").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    shrink = lambda own, above, strength: bind(total(own), lambda t: F.zip_with(own, above, lambda x, g: (x + strength * g) / (t + strength)))
    domains = of_domains.groupBy("domain").agg(_array_of(n, "v").alias("d")).select(F.col("domain").alias("_domain"), shrink(F.col("d"), corpus, domain_strength).alias("d"))
    by_host = hosts.groupBy("host", "domain").agg(_array_of(n, "v").alias("h"))
    both = by_host.join(stored(domains, "domains"), F.col("domain").eqNullSafe(F.col("_domain")))
    textless = scored.select("host").distinct().join(by_host.select(F.col("host").alias("_met")), F.col("host").eqNullSafe(F.col("_met")), "left_anti")
    return both.select(F.col("host").alias("_host"), shrink(F.col("h"), F.col("d"), host_strength).alias("prior")).unionByName(textless.select(F.col("host").alias("_host"), corpus.alias("prior")))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name; a name without dots is its own domain."""
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def address_suffix(host: Column) -> Column:
    """The last label of a host name; empty without a dot."""
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host) of raw web pages: visible text, the ``lang`` of the markup, the host of the address."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)), F.lit(""))
    return pages.select("page_id", text.alias("text"), declared.alias("declared"), F.nullif(host, F.lit("")).alias("host"))


def identify_languages(docs: DataFrame, languages: tuple[str, ...] | None = None, min_confidence: float = MIN_CONFIDENCE, declared: str = "lang",
                       host: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every row: id, ``n_words``, ``declared``, ``text_language`` (by the text alone), ``language``, ``confidence``, ``kept``.

    ``declared`` and ``host`` are expressions over the columns of ``docs``; a NULL declaration and one that names no language say nothing,
    NULL is a host of its own.  ``languages`` are those that ``MIN_TEXTS`` texts declare, unless they are given; declaring another one says nothing.
    A text that none of them explains better than trigrams drawn at random is in 'und' and isn't kept.  NULL and blank texts have no language and
    aren't kept.  Very long texts are read whole, in slices.  Of equal probabilities the language that is first in ``languages`` wins.  Every row comes back
    once, equal rows with equal verdicts; an empty table gives no rows; other columns play no part.
    """
    found = _judged(docs, languages, min_confidence, declared, host, id_col, text_col)
    return found.drop("_key").withColumnRenamed("_id", id_col)


def keep_languages(docs: DataFrame, languages: tuple[str, ...] | None = None, min_confidence: float = MIN_CONFIDENCE, declared: str = "lang",
                   host: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``identify_languages`` keeps, all their columns as they are."""
    found = _judged(docs, languages, min_confidence, declared, host, id_col, text_col)
    return keep_rows(docs, found, id_col, _key(declared, host, id_col, text_col))


def _key(declared: str, host: str, id_col: str, text_col: str) -> Column:
    """What decides the verdict of a row."""
    return row_key(F.col(id_col), F.col(text_col), F.expr(f"cast({declared} as string)"), F.expr(f"cast({host} as string)"))


def _judged(docs: DataFrame, languages: tuple[str, ...] | None, min_confidence: float, declared: str, host: str, id_col: str, text_col: str) -> DataFrame:
    says = declared_language(F.expr(f"cast({declared} as string)"))
    languages = languages or declared_languages(docs, says, text_col)
    n = len(languages)
    model = fit_trigrams(docs, says, languages, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("_id"), _key(declared, host, id_col, text_col).alias("_key"), F.expr(f"cast({declared} as string)").alias("declared"),
                       says.alias("says"), F.expr(f"cast({host} as string)").alias("host"), F.col(text_col).alias("_text"))
    scored = stored(text_likelihood(rows, model), "likelihoods")
    priors = stored(host_priors(scored, languages), "priors")
    # Both sides are plain tables: Spark splits a host that holds much of the corpus.
    fused = scored.join(priors, F.col("host").eqNullSafe(F.col("_host")))
    names = F.split(F.lit(",".join(languages)), ",")
    points = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])[address_suffix(F.col("host"))]
    at = lambda says: F.coalesce(F.array_position(names, says), F.lit(0)).cast("int") - 1  # -1: names no language with a model

    def says_so(place: Column, i: Column, trust: float) -> Column:
        """Log probability of what a source says, given language ``i``; a text in none may say anything."""
        return F.when(place < 0, 0.0).when(i == n, -log(n)).when(i == place, log(trust)).otherwise(log((1 - trust) / max(1, n - 1)))

    prior = F.concat(F.transform("prior", lambda p: p * (1 - NONE_PRIOR)), F.array(F.lit(NONE_PRIOR)))
    best = lambda values: F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("p"), (-i).alias("i"))))
    named = lambda b: F.coalesce(F.get(names, -b["i"]), F.lit(NONE))
    # Staged: each step uses the one before many times.  All steps are arrays over the languages, so the plan is the same for any number of them.
    fused = once(fused, _says=at(F.col("says")), _points=at(points), _prior=prior)
    weights = F.transform(F.zip_with("likelihood", "_prior", lambda x, p: x + F.log(p)), lambda w, i: w + says_so(F.col("_says"), i, DECLARED_TRUST) + says_so(F.col("_points"), i, SUFFIX_TRUST))
    fused = once(fused, _weights=weights)
    fused = once(fused, _best=best(posterior(F.col("_weights"))), _text=best(F.col("likelihood")))
    read = F.col("n_words") > 0
    confidence = F.when(read, F.round(F.col("_best")["p"], 9))
    return fused.select("_id", "_key", "n_words", "declared", F.when(read, named(F.col("_text"))).alias("text_language"), F.when(read, named(F.col("_best"))).alias("language"),
                        confidence.alias("confidence"), F.coalesce((confidence >= min_confidence) & (F.col("_best")["i"] != -n), F.lit(False)).alias("kept"))
