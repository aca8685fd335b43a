"""Plain-Python statement of the day build on a handful of articles, for comparison."""

import re

from corpusdiff.functions.text import DROPPED


def nt(x):
    return "".join(c for c in x if c not in DROPPED)


def grams(x, n):
    x = nt(x).lower()
    return {x} - {""} if len(x) <= n else {x[i : i + n] for i in range(len(x) - n + 1)}


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


class Brute:
    def __init__(self, rules):
        self.r = rules

    def weight(self, x):
        if x in self.r.generic_terms:
            return 0.35
        if any(c in x for c in self.r.military_cues + self.r.policy_cues):
            return 1.2
        return min(1, max(0.45, len(x) / 6))

    def score(self, x):
        for a in self.r.anchors:
            if a.canonical == x:
                return a.score
        for p, s in self.r.anchor_score_patterns:
            if re.search(p, x):
                return s
        return self.r.anchor_score_default

    def high(self, x):
        return self.score(x) >= 0.64 and x not in self.r.generic_judge_terms

    def short(self, x):
        return len(x) >= 4 and self.score(x) >= 0.9 and x not in self.r.generic_judge_terms

    def signals(self, a):
        r, full = self.r, a["title"] + " " + a["analysis_text"]
        norm = re.sub("[—－]", "-", nt(full))
        raw = [nt(n) for n, p in r.scoring_anchors if re.search(p, norm)] + [nt(x) for x in re.findall(r.scoring_event_pattern, norm)]
        raw = [x for x in raw if 4 <= len(x) <= 24 and x not in r.generic_terms]
        cues = r.military_cues + r.policy_cues + r.slogan_cues
        raw += [x for x in re.findall(r.likely_pattern, full) if any(c in x for c in cues)]
        explicit = [x for x in list(dict.fromkeys(raw))[: r.likely_limit] if 2 <= len(x) <= 24]
        anchors = [x.canonical for x in r.anchors if re.search(x.pattern, a["title"] if x.headline_only else full)]
        anchors += [x for x in re.findall(r.event_pattern, full) if 4 <= len(x) <= 24 and self.high(x)]
        fam = [f.family for f in r.topics if all(re.search(p, nt(a["title"]) if f.field == "headline" else norm) for p in f.patterns)]
        page = a["page_number"]
        return dict(
            a, explicit=explicit, anchors=list(dict.fromkeys(anchors)), families=fam, grams=grams(full, 3), tgrams=grams(a["title"], 2),
            cmp=nt(a["title"]).lower(), ct=re.sub(r"[\s\-—–·・:：,，.。\"'“”‘’（）()《》【】［］\[\]、<>/]", "", a["title"]),
            policy=[x for x in explicit if any(c in x for c in r.policy_cues)],
            military=[x for x in explicit if any(c in x for c in r.military_cues)],
            slogan=[x for x in explicit if any(c in x for c in r.slogan_cues) or x in r.generic_terms],
            prom=1.0 if page == 1 else 0.8 if page <= 3 else 0.56 if page <= 7 else 0.34,
        )

    def total(self, terms, scale):
        return min(1, sum(map(self.weight, terms)) / scale)

    def pair(self, l, r):
        if l["ct"] in self.r.ignorable_titles or r["ct"] in self.r.ignorable_titles:
            return None
        both = lambda k: [x for x in l[k] if x in r[k]]
        tsim = 0.0
        if l["cmp"] and r["cmp"]:
            tsim = 1.0 if l["cmp"] == r["cmp"] else 0.84 if l["cmp"] in r["cmp"] or r["cmp"] in l["cmp"] else jac(l["tgrams"], r["tgrams"])
        lex = min(1, tsim * 0.55 + jac(l["grams"], r["grams"]) * 0.45)
        named, pol, slo = self.total(both("explicit"), 5), self.total(both("policy"), 5), self.total(both("slogan"), 5) * 0.72
        bridge = min(1, self.total(l["policy"], 6) * 0.25 + self.total(r["military"], 6) * 0.28 + pol * 0.25 + named * 0.22)
        narr = min(1, named * 0.32 + pol * 0.22 + slo * 0.16 + bridge * 0.3)
        meta = 0.72 + (l["prom"] + r["prom"]) / 2 * 0.28
        conf = min(1, lex * 0.38 + narr * 0.44 + meta * 0.18)
        shared = sorted(set(both("explicit")), key=lambda x: (-self.weight(x), -len(x), x))[:12]
        useful = lambda x: len(x.strip()) >= 2 and x not in self.r.generic_judge_terms
        phrase = []
        if l["ct"] and l["ct"] == r["ct"]:
            phrase = [l["title"].strip()]
        elif l["ct"] and r["ct"]:
            subs = [l["ct"][i:j] for i in range(len(l["ct"])) for j in range(i + 1, len(l["ct"]) + 1)]
            common = max([x for x in subs if x in r["ct"]] or [""], key=len)
            if (len(common) >= 5 or self.short(common)) and common not in self.r.generic_judge_terms:
                phrase = [common]
        direct = list(dict.fromkeys(phrase + sorted([x for x in both("anchors") if useful(x)], key=lambda x: -self.score(x))))
        terms = list(dict.fromkeys(direct + [x for x in shared if useful(x)]))[:8]
        anchor = min(1, sum(map(self.score, direct)) / 2)
        top = (sorted(direct, key=lambda x: (-self.score(x), -len(x))) or [""])[0]
        kind = None
        if l["ct"] and l["ct"] == r["ct"] and (len(l["ct"]) >= 8 or (len(l["ct"]) >= 6 and lex >= 0.82 and meta >= 0.72)):
            kind = "exact"
        elif (len(top) >= 6 or self.short(top)) and (conf >= 0.2 or self.short(top)) and self.high(top):
            kind = "strong_phrase"
        family = next((x for x in l["families"] if x in r["families"]), None)
        hv = any(map(self.high, terms))
        if not (family or kind or terms or conf >= 0.2):
            return None
        prio = {"exact": 3, "strong_phrase": 1.4, None: 0}[kind] + (0.12 if family else 0) + anchor * 1.6 + conf + len(terms) * 0.04
        return dict(
            l=l, r=r, id=f"pair:{l['id']}:{r['id']}", kind=kind, conf=conf, anchor=anchor, terms=terms, hv=hv, prio=prio,
            keyed=bool(set(l["keys"]) & set(r["keys"])) if "keys" in l else True,
            order=(l["pos"], l["id"], r["pos"], r["id"]),
        )

    def candidates(self, articles):
        sig = [self.signals(a) for a in articles]
        out = []
        for l in sig:
            for r in sig:
                if l["side"] == "left" and r["side"] == "right" and l["issue_date"] == r["issue_date"]:
                    c = self.pair(l, r)
                    if c:
                        out.append(c)
        return out

    def pool(self, cands, limit):
        rank = lambda xs: sorted(xs, key=lambda c: (-round(c["prio"], 9), c["order"]))
        picked = {}

        def add(xs):
            for c in xs:
                if len(picked) < limit:
                    picked.setdefault(c["id"], c)

        ranked = rank(cands)
        add([c for c in ranked if c["kind"] == "exact"])
        add([c for c in ranked if c["kind"] == "strong_phrase" or c["anchor"] >= 0.78])
        for side in ("l", "r"):
            groups = {}
            for c in sorted(cands, key=lambda c: c["order"]):
                if c["terms"] or c["kind"]:
                    groups.setdefault(c[side]["id"], []).append(c)
            for g in groups.values():
                add(rank(g)[:3])
        add(ranked)
        return picked

    def accepted(self, cands):
        ok = [c for c in cands if c["kind"] or (c["anchor"] >= 0.72 and c["hv"])]
        exact = {}
        for c in ok:
            if c["kind"] == "exact":
                exact["l" + c["l"]["id"]] = exact["r" + c["r"]["id"]] = c["l"]["ct"]
        return {
            c["id"] for c in ok
            if c["kind"] == "exact" or not (
                "l" + c["l"]["id"] in exact and "r" + c["r"]["id"] in exact and exact["l" + c["l"]["id"]] != exact["r" + c["r"]["id"]]
            )
        }
