"""Problem 10: the subject areas of each document.

Documents become sentences of prose (code is left out), each in its language; a term is a word of a language.

1. Term weights, refined from seeds. The guide's texts give each term a profile over the subjects and a weight, 1 less
   the profile's entropy, so words that fit all subjects count nothing. Documents with a clear subject then give new
   profiles, in each language by itself and balanced over its subjects, for ROUNDS passes. Languages without a guide
   begin with cognates: words whose first letters, in a rough common spelling, are those of known words.
2. A randomised SVD of the matrix of documents and terms, each term scaled by its weight over the root of its document
   frequency, embeds terms, sentences and documents.
3. In each other language the weighted terms fall into as many clusters of directions as there are subjects; clusters
   and subjects are matched one to one by the evidence of profiles and spelling. The clusters' means, and for the
   guide's language the profiles' means, are the seed centroids; passes over all documents refine them.
4. A sentence belongs to the centroid with the greatest cosine. Words of sentences that mostly disagree with the rest
   of their document ("a bad comparison would be ...") are learned; their sentences deal with nothing.
5. A subject counts for a document if a quarter of its sentences belong to it.

All counts are over whole documents. What the driver holds is bounded by VOCABULARY, subjects and languages.

Defined results: null and empty texts, and texts of code only, have no row; repeated documents are judged one by one;
ties go to the subject that comes first in the guide; an empty guide or corpus gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.llm.blocks import sum_blocks
from engine.llm.normal import LINK, plain
from engine.operators.changes import assign
from engine.session import shared_dir
from engine.sources.tables import table

VOCABULARY, RARE = 1 << 17, 3
ROUNDS, COGNATE_ROUNDS = 9, (3, 4, 5, 6, 7, 8)
#: Each language has its own latent directions: one for each subject and EXTRA more.
EXTRA, OVERSAMPLING, POWER = 2, 8, 5
#: Clusters of terms beyond one for each subject, for what fits none.
SPARE = 1
SHARE = 0.25
# Common function words by which a sentence's language is told; the guide is in the first language.
FUNCTION_WORDS = {
    "en": "a an and as at be but by by for have how i in is it my not of on one or that the this to was what with you",
    "de": "an auf bei das dem den der die ein eine es hat ich im ist kann man mir mit nicht nur ohne so und von wenn war warum was zu",
    "es": "al como con creo de del desde el en entre era es ha he la las lo los mi no para por que se si sin su un una y",
}
LANGUAGES = list(FUNCTION_WORDS)
FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b[^>]*>[^<]*\n.*?(?:</code>|\Z)", re.S | re.I)
URL = re.compile(r"\b(?:https?|ftp)://[^\s()<>\[\]\"']+")
CODE = re.compile(r"^(?: {4}|\t)|[;{}]\s*$|^\s*(?:[$>#]\s|def |import |export |return |select .* from |for \w+ in .*:|if .*:\s*$)|^\s*[\w.\[\]]+(?: [-+*/]?= |\()|\[\d\d:\d\d:\d\d", re.I)
END = re.compile(r"(?<=[.?!])[\"'”»)\]]*\s+|\n[ \t]*\n\s*")
WORD = re.compile(r"[^\W\d_]{2,}")


def prose(text: str) -> list[list[str]]:
    """The words of each sentence outside code and links."""
    lines = (x for x in FENCE.sub("\n\n", text).split("\n") if not CODE.search(x))
    t = URL.sub(" ", LINK.sub(r"\1", "\n".join(lines)))
    return [w for s in END.split(t) if s and (w := WORD.findall(plain(s)))]


def tagged(text: str) -> list[tuple[int, list[str]]]:
    """The sentences with the number of their language: that with most function words, else that of the whole text."""
    own = [set(x.split()) for x in FUNCTION_WORDS.values()]

    def language(ws, other):
        n = [sum(w in f for w in ws) for f in own]
        return n.index(max(n)) if max(n) and n.count(max(n)) == 1 else other

    s = prose(text)
    whole = language([w for x in s for w in x], 0)
    return [(language(x, whole), x) for x in s]


def vocabulary(docs: DataFrame) -> list[tuple[int, str]]:
    """The (language, word) terms that occur in RARE documents or more, the VOCABULARY most frequent of them."""
    split = tagged

    def terms(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            n = Counter(t for text in batch.column("text").to_pylist() for t in {(g, w) for g, s in split(text) for w in s})
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in n], pa.int32()), pa.array([t[1] for t in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["g", "w", "n"])

    counts = docs.select("text").mapInArrow(terms, "g int, w string, n bigint").groupBy("g", "w").agg(F.sum("n").alias("n"))
    return [(r["g"], r["w"]) for r in counts.where(F.col("n") >= RARE).orderBy(F.desc("n"), "g", "w").limit(VOCABULARY).collect()]


def encoded(docs: DataFrame, terms: dict[tuple[int, str], int]) -> DataFrame:
    """(doc_id, codes, ends): the known terms of all sentences in a row, and where each sentence ends."""
    split = tagged

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            codes, ends = [], []
            for text in batch.column("text").to_pylist():
                c, e = [], []
                for g, s in split(text):
                    c += [terms[(g, w)] for w in s if (g, w) in terms]
                    e.append(len(c))
                codes.append(c)
                ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "codes", "ends"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, codes array<int>, ends array<int>")


def _pairs(batch, size):
    """(doc, term) of a batch, each pair once, in order of doc; and the number of docs."""
    import numpy as np

    column = batch.column("codes")
    length = np.diff(column.offsets.to_numpy())
    doc = np.repeat(np.arange(len(length)), length)
    u = np.unique(doc.astype(np.int64) * size + column.flatten().to_numpy(zero_copy_only=False))
    return u // size, u % size, len(length)


def _entropy_weights(p):
    import numpy as np

    return 1 + (p * np.log(p)).sum(1) / np.log(p.shape[1])


def fold(word: str) -> str:
    """A rough spelling common to the languages."""
    for a, b in (("ph", "f"), ("th", "t"), ("y", "i"), ("k", "c"), ("z", "s"), ("h", "")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1", r"\1", word)


class Model:
    """Terms with their language, IDF, profile over the subjects and weight."""

    def __init__(self, terms: list[tuple[int, str]], n_subjects: int):
        import numpy as np

        self.terms, self.s = terms, n_subjects
        self.of = {t: i for i, t in enumerate(terms)}
        self.language = np.array([g for g, _ in terms], dtype=np.int64)
        self.folded = [fold(w) for _, w in terms]
        self.profile = np.full((len(terms), n_subjects), 1 / n_subjects)
        self.weight = np.zeros(len(terms))
        self.known = np.zeros(len(terms))

    def frequencies(self, codes: DataFrame) -> None:
        import numpy as np

        size, language, pairs = len(self.terms), self.language, _pairs

        def work(batch, total):
            import numpy as np

            d, t, _ = pairs(batch, size)
            total[:size, 0] += np.bincount(t, minlength=size)
            seen = np.unique(d * 8 + language[t]) % 8
            total[size : size + 8, 0] += np.bincount(seen, minlength=8)

        n = sum_blocks(codes, work, size + 8, 1)[:, 0]
        self.df, docs = n[:size], np.maximum(n[size:], 1)[self.language]
        self.idf = np.maximum(np.log((1 + docs) / (1 + self.df)) / np.log(1 + docs), 0)

    def learn(self, counts, docs, prior: float) -> None:
        """Profiles from class counts of terms (terms x subjects) and of documents (languages x subjects)."""
        import numpy as np

        balanced = np.zeros_like(counts)
        for g in range(len(docs)):
            rows, have = self.language == g, docs[g] >= 3
            if have.any():
                r = counts[rows] / np.maximum(docs[g], 1) * docs[g][have].mean()
                r[:, ~have] = r[:, have].mean(1, keepdims=True)
                balanced[rows] = r
        p = balanced + prior
        self.profile = p / p.sum(1, keepdims=True)
        self.known = counts.sum(1)
        self.weight = _entropy_weights(self.profile) * np.minimum(1, self.known / 4)

    def cognates(self):
        """(terms x subjects) evidence of spelling for the terms of languages without a guide."""
        import numpy as np

        begins: dict = {}
        for i in np.flatnonzero((self.language == 0) & (self.weight > 0.4)):
            for k in range(5, min(8, len(self.folded[i])) + 1):
                begins[self.folded[i][:k]] = begins.get(self.folded[i][:k], 0) + self.profile[i] * self.weight[i]
        out = np.zeros((len(self.terms), self.s))
        for i in np.flatnonzero(self.language > 0):
            f = self.folded[i]
            k = next((k for k in range(min(8, len(f)), 4, -1) if f[:k] in begins), 0)
            if k:
                p = (begins[f[:k]] + 0.02)[None] / (begins[f[:k]] + 0.02).sum()
                out[i] = _entropy_weights(p)[0] * (p[0] - 1 / self.s) * {5: 0.5, 6: 0.75}.get(k, 1.0) * min(1.0, self.idf[i] / 0.2)
        return out

    def round(self, codes: DataFrame, extra) -> None:
        """One pass: documents with a clear subject give new profiles."""
        size, s, language, pairs = len(self.terms), self.s, self.language, _pairs
        score = (self.weight * self.idf)[:, None] * (self.profile - 1 / s) + extra

        def work(batch, total):
            import numpy as np

            d, t, n = pairs(batch, size)
            if not len(d):
                return
            at = np.flatnonzero(np.diff(d, prepend=-1))
            z = np.zeros((n, s))
            z[d[at]] = np.add.reduceat(score[t], at)
            order = np.argsort(-z, axis=1, kind="stable")
            first, second = (np.take_along_axis(z, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
            clear = (first > 0.12) & (first > 1.7 * np.maximum(second, 0))
            on = clear[d]
            np.add.at(total, (t[on], order[d[on], 0]), 1)
            seen = np.unique(d[on] * 8 + language[t[on]])
            np.add.at(total, (size + seen % 8, order[seen // 8, 0]), 1)

        got = sum_blocks(codes, work, size + 8, s)
        self.learn(got[:size], got[size:], 0.5)


def uncovered(model: Model) -> None:
    """Terms that clear documents leave out, other than their language as a whole, belong to a subject not found yet: they get weight too."""
    import numpy as np

    share = model.known / np.maximum(model.df, 1)
    for g in range(1, len(LANGUAGES)):
        own = model.language == g
        if own.any():
            usual = np.average(share[own], weights=model.df[own] + 1e-9)
            model.weight[own] = np.maximum(model.weight[own], np.where(model.df[own] >= 4, 1 - share[own] / max(usual, 1e-9), 0))


def embed(codes: DataFrame, model: Model):
    """(terms x rank): each term's share of a latent vector, from the randomised SVD of the weighted matrix of all documents."""
    import numpy as np

    size, pairs = len(model.terms), _pairs
    w = model.weight / np.sqrt(np.maximum(model.df, 1))  # so that a rare subject or language gets its direction too
    each = model.s + EXTRA + OVERSAMPLING  # columns of the block that belong to one language
    k = each * len(LANGUAGES)
    own = model.language[:, None] == np.arange(k) // each

    def multiply(block):
        def work(batch, total):
            import numpy as np

            d, t, _ = pairs(batch, size)
            if not len(d):
                return
            at = np.flatnonzero(np.diff(d, prepend=-1))
            rows = np.add.reduceat(block[t], at)
            of = np.cumsum(np.diff(d, prepend=d[0]) != 0)
            order = np.argsort(t, kind="stable")
            start = np.flatnonzero(np.diff(t[order], prepend=-1))
            total[t[order][start]] += np.add.reduceat(rows[of[order]], start) * w[t[order][start], None]

        return work

    def orthonormal(y):
        y = np.where(own, y, 0)
        for g in range(len(LANGUAGES)):
            rows, columns = np.flatnonzero(model.language == g), slice(g * each, g * each + min(each, int((model.language == g).sum())))
            if len(rows):
                y[rows, columns] = np.linalg.qr(y[rows, columns])[0]
        return y

    q = orthonormal(np.random.default_rng(10).standard_normal((size, k)))
    for _ in range(POWER):
        q = orthonormal(sum_blocks(codes, multiply(w[:, None] * q), size, k))
    return w[:, None] * q[:, np.arange(k) % each < model.s + EXTRA]


def seeds(model: Model, latent):
    """(languages x subjects x rank) seed centroids."""
    import numpy as np

    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    out = np.zeros((len(LANGUAGES), model.s, latent.shape[1]))
    strong = (model.weight > np.where(model.language == 0, 0.3, 0.12)) & (model.df >= 4) & (np.linalg.norm(latent, axis=1) > 1e-9)
    spelled = model.cognates()
    for g in range(len(LANGUAGES)):
        own = np.flatnonzero(strong & (model.language == g))
        if not len(own):
            continue
        vectors, mass = unit(latent[own]), (model.weight * np.sqrt(model.df))[own]
        if g == 0:
            out[g] = unit((((model.profile[own] - 1 / model.s).clip(0) * mass[:, None])[:, :, None] * vectors[:, None, :]).sum(0))
            continue
        k = min(model.s + SPARE, len(own))
        at, c = _clusters(vectors, model.weight[own], k)
        # what speaks for subject s in cluster i: spelling, and the profiles that spelling has led to
        case = np.zeros((k, model.s))
        np.add.at(case, at, 3 * spelled[own].clip(0) + (model.profile[own] - 1 / model.s).clip(0) * model.weight[own, None])
        english = np.flatnonzero(strong & (model.language == 0) & (model.weight > 0.5))
        case += 0.2 * _alike(model, own, at, k, english).clip(0) + 0.1 * np.bincount(at, minlength=k)[:, None]  # of equal cases the larger cluster
        for i, s in enumerate(assign(case.tolist())):
            if s >= 0:
                out[g, s] = c[i]
    return out


def _clusters(vectors, mass, k: int, tries: int = 60):
    """The cluster of each vector and the centres: spherical k-means, the best of several starts with vectors far apart."""
    import numpy as np

    rng, best = np.random.default_rng(0), (-np.inf, None, None)
    for _ in range(tries):
        c = vectors[[rng.choice(len(vectors), p=mass / mass.sum())]]
        while len(c) < k:
            far = (1 - (vectors @ c.T).max(1)).clip(1e-9) ** 2 * mass
            c = np.concatenate([c, vectors[[rng.choice(len(vectors), p=far / far.sum())]]])
        for _ in range(15):
            at = (vectors @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, at, vectors * mass[:, None])
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 1e-9, sums / np.maximum(size, 1e-12), c)
        fit = float(((vectors @ c.T).max(1) * mass).sum())
        if fit > best[0]:
            best = (fit, (vectors @ c.T).argmax(1), c)
    return best[1], best[2]


def _alike(model: Model, own, at, k: int, english):
    """(clusters x subjects): how alike the clusters' words are to the best of each subject's words, by pairs of letters."""
    import numpy as np

    pairs = [frozenset(a + b for a, b in zip(model.folded[i], model.folded[i][1:], strict=False)) for i in english]
    subject = model.profile[english].argmax(1)
    out = np.zeros((k, model.s))
    for x, i in zip(own, at, strict=True):
        mine = {a + b for a, b in zip(model.folded[x], model.folded[x][1:], strict=False)}
        best = np.zeros(model.s)
        for p, s in zip(pairs, subject, strict=True):
            if mine and p:
                best[s] = max(best[s], 2 * len(mine & p) / (len(mine) + len(p)))
        out[i] += best**2 - (best**2).mean()
    return out


def _sentences(batch, latent, centroids, language, chosen=0.4):
    """For each sentence of a batch: its doc, its subject (-1: none) and the terms' sentence numbers."""
    import numpy as np

    codes, ends = batch.column("codes"), batch.column("ends")
    n_terms, n_sent = np.diff(codes.offsets.to_numpy()), np.diff(ends.offsets.to_numpy())
    flat = codes.flatten().to_numpy(zero_copy_only=False)
    start = np.repeat(np.cumsum(n_terms) - n_terms, n_sent)
    stop = start + ends.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(n_sent)), n_sent)
    first = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    of = np.repeat(np.arange(len(stop)), stop - first)
    z = np.zeros((len(stop), latent.shape[1]))
    g = np.zeros(len(stop), dtype=np.int64)
    if len(flat):
        at = np.flatnonzero(np.diff(of, prepend=-1))
        z[of[at]] = np.add.reduceat(latent[flat], at)
        g[of[at]] = language[flat[at]]
    size = np.linalg.norm(z, axis=1)
    cos = np.einsum("nr,nsr->ns", z / np.maximum(size, 1e-12)[:, None], centroids[g]) if len(z) else np.zeros((0, centroids.shape[1]))
    best = cos.argmax(1) if len(cos) else np.zeros(0, dtype=int)
    subject = np.where((size > 1e-6) & (cos.max(1, initial=-1) >= chosen), best, -1)
    return doc, subject, flat, of, z, g, len(n_sent)


def _main(doc, subject, n, s):
    """The number of sentences of each doc and subject, and the main subject (-1: none)."""
    import numpy as np

    count = np.zeros((n, s))
    np.add.at(count, (doc[subject >= 0], subject[subject >= 0]), 1)
    return count, np.where(count.any(1), count.argmax(1), -1)


def refine(codes: DataFrame, model: Model, latent, centroids):
    """Centroids as the mean of the sentences whose document has the same main subject."""
    import numpy as np

    language, s, sentence, main_of = model.language, model.s, _sentences, _main

    def work(batch, total):
        import numpy as np

        doc, subject, _, _, z, g, n = sentence(batch, latent, centroids, language)
        _, main = main_of(doc, subject, n, s)
        on = (subject >= 0) & (subject == main[doc])
        np.add.at(total, g[on] * s + subject[on], z[on])

    total = sum_blocks(codes, work, len(LANGUAGES) * s, latent.shape[1]).reshape(centroids.shape)
    size = np.linalg.norm(total, axis=2, keepdims=True)
    return np.where(size > 1e-9, total / np.maximum(size, 1e-12), centroids)


def asides(codes: DataFrame, model: Model, latent, centroids):
    """(terms,): the share of a term's sentences, in documents with a clear main subject, that are about another one."""
    import numpy as np

    language, s, sentence, main_of, size = model.language, model.s, _sentences, _main, len(model.terms)

    def work(batch, total):
        import numpy as np

        doc, subject, flat, of, _, _, n = sentence(batch, latent, centroids, language)
        count, main = main_of(doc, subject, n, s)
        clear = (count.max(1, initial=0) >= 3) & (count.max(1, initial=0) >= 0.6 * count.sum(1))
        u = np.unique(of.astype(np.int64) * size + flat)
        x, t = u // size, u % size
        on = (subject[x] >= 0) & clear[doc[x]]
        np.add.at(total, (t[on], (subject[x[on]] != main[doc[x[on]]]).astype(int)), 1)

    n = sum_blocks(codes, work, size, 2)
    return np.where((n.sum(1) >= 8) & (model.weight < 0.3), n[:, 1] / np.maximum(n.sum(1), 1), 0.0)


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, subject, n_sentences, share) of every document and subject with a sentence."""
    import numpy as np

    shared_dir(spark, "subjects")  # names the checkpoint folder
    guide = [r for r in table(spark, sf_dir, "subject_guide").orderBy("subject_id").collect() if r["subject"]]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    schema = "doc_id bigint, subject string, n_sentences bigint, share double"
    seed_texts = [[w for _, w in tagged(f"{r['sample_text'] or ''}")] + [WORD.findall(plain(x)) for x in (r["sample_terms"] or "").split(",")] for r in guide]
    terms = list(dict.fromkeys([*vocabulary(docs), *((0, w) for g in seed_texts for s in g for w in s)]))
    if not guide or not terms:
        return spark.createDataFrame([], schema)
    model = Model(terms, len(guide))
    codes = encoded(docs, model.of).checkpoint()
    model.frequencies(codes)
    counts = np.zeros((len(terms), len(guide)))
    for s, g in enumerate(seed_texts):
        for sentence in g:
            for w in set(sentence):
                counts[model.of[(0, w)], s] += 1
    model.learn(counts, np.array([[len(g) for g in seed_texts]]), 0.3)
    model.weight = np.where(counts.sum(1) > 0, _entropy_weights(model.profile), 0)
    for r in range(ROUNDS):
        extra = model.cognates() * (1 if r < 5 else 0.5) if r in COGNATE_ROUNDS else np.zeros_like(counts)
        model.round(codes, extra)
    uncovered(model)
    latent = embed(codes, model)
    centroids = seeds(model, latent)
    for _ in range(2):
        centroids = refine(codes, model, latent, centroids)
    aside = asides(codes, model, latent, centroids) > 0.6
    names, language, sentences_of = [r["subject"] for r in guide], model.language, _sentences
    light, centres = latent.astype(np.float32), centroids.astype(np.float32)

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            doc, subject, flat, of, _, _, n = sentences_of(batch, light, centres, language)
            subject = np.where(np.bincount(of, aside[flat], len(subject)) > 0, -1, subject) if len(flat) else subject
            count = np.zeros((n, len(names)))
            np.add.at(count, (doc[subject >= 0], subject[subject >= 0]), 1)
            total = np.bincount(doc, minlength=n)
            d, s = np.nonzero(count)
            ids = batch.column("doc_id").take(pa.array(d))
            yield pa.RecordBatch.from_arrays([ids, pa.array([names[x] for x in s], pa.string()), pa.array(count[d, s].astype(np.int64)), pa.array(count[d, s] / total[d])], names=["doc_id", "subject", "n_sentences", "share"])

    return codes.mapInArrow(judge, schema)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark, sf_dir).where(F.col("share") >= SHARE).select("doc_id", "subject")


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents that have it, and sentences."""
    s = shares(spark, sf_dir)
    return s.groupBy("subject").agg(F.count_if(F.col("share") >= SHARE).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
