"""Rule tables over texts: study design, expected elements, Bayesian gate, manifest flags.

Rules are phrases, not patterns: words in order, `*` for any ending of a word, `|` between
alternatives of one signal; a space stands for white space or a hyphen. Each signal becomes
one rlike in one select, so that its pattern is compiled once and the text is scanned in
place; a classification needs no shuffle. Patterns keep to what Java and RE2 both read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phrase(signal: str) -> str:
    """The pattern of a signal: 'random* assign* | coin toss' is either phrase, as whole words."""
    def one(words: str) -> str:
        return r"\b" + r"[\s-]+".join(re.escape(w.rstrip("*")) + (r"\w*" if w.endswith("*") else "") for w in words.split()) + (r"\b" if words.strip()[-1].isalnum() else "")

    return "|".join(one(words) for words in signal.split("|"))


def _signals(text: str) -> tuple[str, ...]:
    """The patterns of signals that stand one on a line."""
    return tuple(phrase(line.strip()) for line in text.strip().splitlines())


def _design(strong: str, weak: str) -> dict[str, tuple[str, ...]]:
    return {"strong": _signals(strong), "weak": _signals(weak)}


#: Designs in order of priority: strong signals name what only such a study does, weak ones what others mention too.
DESIGNS: dict[str, dict[str, tuple[str, ...]]] = {
    "evidence_synthesis": _design(
        """search strateg* | search terms | search string*
        databases were searched | we searched | was searched | literature search | database search
        records were screened | records screened | titles and abstracts
        studies were included | studies met | articles were included
        prisma | duplicates were removed
        data extraction form | extracted by two | extracted independently""",
        """systematic review*
        meta analys* | metaanalys*
        scoping review* | umbrella review* | rapid review*
        eligibility criteria | inclusion criteria
        pooled estimate* | pooled effect* | pooled mean*
        included studies | included trials
        flow diagram | forest plot* | funnel plot*""",
    ),
    "simulation": _design(
        """simulation study | simulation experiment*
        data generating
        simulated datasets | simulated data sets | simulated data | simulated samples""",
        """monte carlo
        replications | replicates | repetitions per
        true parameter* | coverage probabilit* | known truth""",
    ),
    "randomised_trial": _design(
        """randomly assigned | randomly allocated | random allocation | random assignment | were randomised to | were randomized to
        allocation sequence | allocation concealment | sealed envelope*
        trial registr* | registered trial | consort
        randomised controlled | randomized controlled""",
        """placebo* | sham
        control arm | control group | intervention arm | treatment arm | intervention group
        single blind* | double blind* | masked assess* | blinded assess*
        intention to treat""",
    ),
    "qualitative": _design(
        """thematic analysis | content analysis of interviews
        grounded theory | phenomenolog*
        focus group*
        semi structured interview* | in depth interview*""",
        """verbatim | transcribed | transcripts
        saturation
        coding frame | codebook | reflexiv*""",
    ),
    "measurement_validation": _design(
        """limits of agreement | bland altman
        test retest
        intraclass correlation* | measurement error
        typical error | minimal detectable change | validation of the""",
        """reliability
        criterion validity | construct validity | concurrent validity | validity
        coefficient of variation | coefficients of variation""",
    ),
    "case_control": _design("""case control
        cases and controls | cases versus controls | cases were compared with controls""", """matched control* | matched for age
        odds ratio* | exposure histor*"""),
    "cohort": _design(
        """cohort study | prospective cohort | retrospective cohort | birth cohort
        followed for | followed up for | were followed | follow up of""",
        """longitudinal*
        baseline | at enrolment
        incidence | person years""",
    ),
    "survey": _design("""response rate*
        online survey | postal survey | web survey | telephone survey | survey was sent
        completed the questionnaire | questionnaire was | questionnaires were""", """respondent*
        likert | questionnaire*"""),
    "secondary_analysis": _design("""secondary analysis | secondary analyses
        reanalysis of | re analysis of | existing dataset* | archived data""", """publicly available | open data | data were obtained
        routinely collected | registry data"""),
    "cross_sectional": _design("""cross sectional
        one point in time | single visit | one occasion""", """prevalence
        correlational | associations between"""),
}
LEAST_SIGNALS, LEAST_STRONG = 2, {"measurement_validation": 2}
#: Collocations in which "monte carlo" speaks of estimation and not of a simulation.
ESTIMATION = r"\b(markov chain|hamiltonian|sequential) monte carlo\b"

# Bibliographic databases, and the platforms through which they are searched.
DATABASES = ("pubmed", "medline", "embase", "scopus", "web of science", "sportdiscus", "cinahl", "psyc ?info", "cochrane", "google scholar", "openalex", r"dimensions\.ai", "scielo", "eric", "lilacs")
PLATFORMS = ("ovid", "ebscohost", "proquest", "sciencedirect", "springerlink", "jstor")
#: Elements that an evidence synthesis should report: what shows each.
ELEMENTS = {
    "heterogeneity": phrase("heterogene* | i squared | i2 statistic* | tau squared | tau2 | cochran* q | q statistic | prediction interval* | between study varia*") + "|\\bi²|[τt]au²|τ²|τ2",
    "publication_bias": phrase("publication bias | small study effect* | funnel plot* | egger* | begg* | trim and fill | fail safe n | selection model* | p curve"),
    "risk_of_bias": phrase("risk of bias | rob 2 | robins i | quadas* | pedro scale | pedro score* | jadad | newcastle ottawa | amstar* | critical appraisal | methodological quality | quality assessment | certainty of evidence | certainty of the evidence"),
    "registration": phrase("prospero | preregist* | pre registered | pre registration | registered protocol | protocol was registered | registration number | osf registr*"),
}
INCLUSION, EXCLUDED = phrase("inclusion criteri* | eligib* | were included if | we included"), phrase("exclusion criteri* | exclu* | ineligib* | not eligible")
#: Screening by more than one, said in one sentence: who, and what they did.
SCREENERS, SCREENED = phrase("two reviewers | two authors | two raters | both authors | pairs of reviewers | second reviewer | second author | independent* | in duplicate | dual"), phrase("screen* | select* | review* | assess* | extract* | code* | rate*")
#: What a sentence of exclusions may restrict.
RESTRICTIONS = {
    "language": phrase("english | language* | non english"), "grey_literature": phrase("grey literature | gray literature | unpublished | preprint* | conference abstract* | conference paper* | proceedings | theses | dissertation*"),
    "design": phrase("crossover | cross over | case report* | case series | case stud* | qualitative | single group | uncontrolled | observational | repeated measures"), "publisher": phrase("predatory | publisher* | beall*"),
}
EXCLUSION = phrase("exclu* | ineligible | not eligible | were removed | was removed | were omitted | left out | discarded | not considered | restricted to | limited to")
#: Signals that a Bayesian analysis was reported, and those that one was run.
BAYES_STRONG = {"prior": r"\bpriors?\b[^.]{0,60}\b(placed|specified|set|normal|cauchy|flat|informative)\b", "credible_interval": r"\bcredible intervals?\b", "posterior": r"\bposterior (distribution|mean|median|predictive|probability)\b", "bayes_factor": r"\bbayes factors?\b", "sampler": r"\b(mcmc|hamiltonian|gibbs|no-u-turn)\b", "convergence": r"\br[- ]?hat\b|\beffective sample size\b|\btrace plots?\b"}
BAYES_RUN = r"\b(chains?|iterations|warm-?up|draws)\b|\bbayesian (model|analysis|regression|meta-analysis)\b"
BAYES_ELEMENTS = {"priors": r"\bpriors?\b", "convergence": r"\br[- ]?hat\b|\beffective sample size\b|\btrace plots?\b|\bconverge\w*\b", "sampler_settings": r"\bchains?\b|\biterations\b|\bdraws\b", "software": r"\b(stan|jags|brms|pymc|winbugs|inla)\b"}
#: Document-level flags of the manifest.
FLAGS = {
    "confidence_intervals": phrase("confidence interval* | 95 % ci | credible interval* | interval from | interval of") + r"|\b95 ?% ?ci\b",
    "p_values": r"\bp ?[<=>] ?0?\.\d+|" + phrase("p value*"),
    "standard_deviation": r"\bsds?\b ?[=:]? ?\d|" + phrase("standard deviation*"),
    "odds_ratio": phrase("odds ratio*"),
    "equation_reference": r"\beqs?\. ?\(?\d|" + phrase("equation*"),
    "missing_data": phrase("missing data | missing value* | missingness | imput* | dropped out | drop out* | dropout* | attrition | lost to follow up"),
}
RANDOMISED, NOT_RANDOMISED = r"\brandomi[sz]ed\b|\brandomly\b", r"\b(not|non|without)[- ]?(been |be )?random\w*\b"


SENTENCE_END = r"[.;:]\s+"


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, split at the bars outside of groups and classes."""
    parts, depth, classed, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif classed:
            classed = c != "]"
        elif c == "[":
            classed = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def anchor(pattern: str) -> str:
    """The longest text that every match of a pattern without outer alternatives holds; '' if none is sure."""
    plain = re.sub(r"\[[^\]]*\][?*+]?(?:\{[^}]*\})?", "\0", pattern)
    while re.search(r"\([^()]*\)", plain):
        plain = re.sub(r"\([^()]*\)[?*+]?(?:\{[^}]*\})?", "\0", plain)
    plain = re.sub(r"\\\.", "\1", plain)  # an escaped full stop is text
    plain = re.sub(r"(?:\\[a-zA-Z]|.)(?:[?*]|\{[^}]*\})|\\[a-zA-Z]\+?|\.\+?", "\0", plain)
    return max((run.replace("\1", ".") for run in re.split(r"[\0^$+]", plain)), key=len, default="")


def matches(text: Column, pattern: str) -> Column:
    """text.rlike(pattern), but for each alternative only where the text holds its anchor: a plain search is many times faster, and most texts hold few."""
    hit = None
    for p in _alternatives(pattern):
        a = anchor(p)
        one = text.contains(a) & text.rlike(p) if len(a) > 2 else text.rlike(p)
        hit = one if hit is None else hit | one
    return hit


def _hits(text: Column, patterns) -> Column:
    """How many of the patterns a lower-case text matches."""
    total = F.lit(0)
    for p in patterns:
        total = total + matches(text, p).cast("int")
    return total


def classified_designs(df: DataFrame, text: str) -> DataFrame:
    """df without its text, with design, signals and runners_up: the first design by priority that fires, how many signals it has, and how many others fire.

    A design fires with its strong signals (one, two for measurement validation) and two
    signals in all. A text that fires none, null and empty ones too, is 'unclassified'.
    """
    kept = [F.col(c) for c in df.columns if c not in (text, "design", "signals", "runners_up")]
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counted = df.select(*kept, *[_hits(F.when(low.contains("monte carlo"), F.regexp_replace(low, ESTIMATION, " ")).otherwise(low) if d == "simulation" else low, s[k]).alias(f"__{d}_{k}") for d, s in DESIGNS.items() for k in ("strong", "weak")])
    case, signals, fired = None, None, F.lit(0)
    for d in DESIGNS:
        strong, all_ = F.col(f"__{d}_strong"), F.col(f"__{d}_strong") + F.col(f"__{d}_weak")
        fires = (strong >= LEAST_STRONG.get(d, 1)) & (all_ >= LEAST_SIGNALS)
        case = F.when(fires, d) if case is None else case.when(fires, d)
        signals = F.when(fires, all_) if signals is None else signals.when(fires, all_)
        fired = fired + fires.cast("int")
    return counted.select(*kept, case.otherwise("unclassified").alias("design"), signals.otherwise(0).alias("signals"), F.greatest(fired - 1, F.lit(0)).alias("runners_up"))


def expected_elements(df: DataFrame, text: str) -> DataFrame:
    """One row per text and element of an evidence synthesis, with its kind: present, restriction or absent.

    Two databases are present, one is a restriction; a platform is no database and has a row
    of its own where it is named. Criteria of inclusion and of exclusion are present
    together; one without the other is a restriction. Independent screening needs who and
    what in one sentence. A restriction of the exclusions is only reported where it is found.
    """
    kept = [F.col(c) for c in df.columns if c not in (text, "element", "kind")]
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    named = _hits(low, [rf"\b{d}\b" for d in DATABASES])
    row = lambda name, kind: F.struct(F.lit(name).alias("element"), kind.alias("kind"))
    found = [row("databases", F.when(named >= 2, "present").when(named == 1, "restriction").otherwise("absent")), row("platforms", F.when(_hits(low, [rf"\b{d}\b" for d in PLATFORMS]) > 0, "present"))]
    found += [row(k, F.when(matches(low, p), "present").otherwise("absent")) for k, p in ELEMENTS.items()]
    inside, outside = matches(low, INCLUSION), matches(low, EXCLUDED)
    found.append(row("criteria", F.when(inside & outside, "present").when(inside | outside, "restriction").otherwise("absent")))
    both = matches(low, SCREENERS) & F.exists(F.split(low, SENTENCE_END), lambda s: s.rlike(SCREENERS) & s.rlike(SCREENED))
    found.append(row("independent_screening", F.when(both, "present").otherwise("absent")))
    # only texts that speak of exclusions are cut into sentences
    excluding = F.when(matches(low, EXCLUSION), F.array_join(F.filter(F.split(low, SENTENCE_END), lambda s: s.rlike(EXCLUSION)), " . ")).otherwise("")
    found += [row(f"restricted_{k}", F.when(matches(excluding, p), "restriction")) for k, p in RESTRICTIONS.items()]
    return df.select(*kept, F.inline(F.array(*found))).filter("kind is not null")


def bayesian_gate(df: DataFrame, text: str) -> DataFrame:
    """df without its text, with strong_signals, gate_open, and for open gates how many of the four elements are absent (else null)."""
    kept = [F.col(c) for c in df.columns if c not in (text, "strong_signals", "gate_open", "absent_elements")]
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    strong = _hits(low, BAYES_STRONG.values())
    open_ = (strong >= 2) & matches(low, BAYES_RUN)
    return df.select(*kept, strong.alias("strong_signals"), open_.alias("gate_open"), F.when(open_, len(BAYES_ELEMENTS) - _hits(low, BAYES_ELEMENTS.values())).alias("absent_elements"))


def manifest_flags(df: DataFrame, text: str) -> DataFrame:
    """df without its text, with a boolean for each flag; randomised is judged by sentence, and a negated sentence doesn't count."""
    kept = [F.col(c) for c in df.columns if c not in (text, "randomised", *FLAGS)]
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    randomised = low.contains("random") & F.exists(F.split(low, r"[.;:!?]\s+"), lambda s: s.rlike(RANDOMISED) & ~s.rlike(NOT_RANDOMISED))
    return df.select(*kept, *[matches(low, p).alias(k) for k, p in FLAGS.items()], randomised.alias("randomised"))


def contradicted_absences(flags: DataFrame, claims: DataFrame, id_column: str) -> DataFrame:
    """(id, flag, sentence): sentences of df(id, flag, sentence) that say a thing is absent which the manifest has."""
    present = flags.select(id_column, F.explode(F.map_filter(F.create_map(*[x for f in [*FLAGS, "randomised"] for x in (F.lit(f), F.col(f))]), lambda k, v: v)).alias("flag", "there"))
    return claims.join(present.select(id_column, "flag"), [id_column, "flag"]).select(id_column, "flag", "sentence")
