"""Invented texts with marked personal information, to train the tagger on and to hold out.

The training and the held-out generator share the rules by which numbers are made, but no name, town, street or sentence.
"""

from __future__ import annotations

import random
import re

Marks = list[tuple[int, int, str]]

#: Common given and family names, towns and streets of several countries. Every third is held out.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Helen "
    "Wei Li Xin Yan Hao Jing Min Hiroshi Yuki Sakura Haruto Akira Ravi Anjali Arjun Deepa Sanjay Kavita Ahmed Fatima Omar Layla Hassan Zainab Ivan Dmitri Svetlana Natasha Sergei Katya Lukas Hans "
    "Jürgen Ursula Heike Klaus Sabine François Pierre Chloé Amélie Luc Giulia Matteo Lorenzo Chiara José Carlos Lucía Javier Ana Miguel João Inês Tiago Mateus Lars Astrid Søren Freya Mikko Aino "
    "Kwame Ama Chidi Ngozi Thabo Zanele Abebe Amina Juan Sofía Diego Valentina Liam Emma Noah Olivia Ethan Ava Mason Isla Oliver Amelia Jack Harriet George Alice Bo Jo Al Tim Sam Ian"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams "
    "Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Zhang Wang Chen Liu Yang Huang Zhao Wu Tanaka Suzuki Sato Watanabe "
    "Kim Park Choi Nguyen Tran Patel Sharma Singh Gupta Kumar Reddy Khan Hussain Ali Ivanov Petrov Smirnova Kuznetsov Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Dubois Lefebvre "
    "Moreau Laurent Rossi Russo Ferrari Esposito García Fernández González Rodríguez López Martínez Silva Santos Oliveira Costa Hansen Johansson Larsen Nielsen Korhonen Okafor Mensah Dlamini "
    "Kowalski Nowak Novák Horvat Papadopoulos O'Brien O'Connor McDonald MacLeod FitzGerald"
).split()
TOWNS = "London|Leeds|Bristol|York|Oxford|Dublin|Boston|Chicago|Denver|Portland|New York|San Diego|Austin|Salt Lake City|Toronto|Sydney|Berlin|München|Köln|Bad Homburg|Paris|Lyon|Saint-Denis|Madrid|Sevilla|San Sebastián|Roma|Milano|Amsterdam|Utrecht|Wien|Zürich".split("|")
STREETS = "High|Baker|Church|Park|Victoria|Green Hill|Station|Mill|Oak|Maple|Washington|Elm|King|Queen|Lake View|Cedar|Pine|North|Chapel|Sunset".split("|")
STEMS = "Haupt|Bahnhof|Garten|Schul|Berg|Linden|Goethe|Ring|Kirch|Wald|Friedrich|Mozart".split("|")
ROADS = "Mayor|Alcalá|Serrano|Colón|Goya|Sol|Rivoli|Lafayette|Victor Hugo|Paix|République|Pasteur".split("|")
WORDS = "server cache queue build parser index thread token module branch commit test release user client batch stream logger schema table metric plugin driver worker socket buffer cluster region memory config".split()
VERBS = "fails works restarts blocks loads waits returns breaks compiles starts merges retries drops scales".split()
FILL = "the a an of to in on for with by from as is was are were be has had do did will can may not and or but so if when then than that this these it he she they we you i my our your their his her its one two all any some new old first last next good late early soon again still only also even more most other same own very here there now about after before over under between during because while where who whom whose which what how old user team report note form order letter parcel nurse tenant driver guest pilot buyer author lawyer tutor neighbour sister uncle boss".split()
LEADS = "Hi Dear Did Has Will Let Tell Email Ping Meet Visit Why If Since With For Both Patient Client Driver Manager Sincerely Cheers Yours Love From To Via Per Sender Owner Editor Speaker Host Nurse Judge Captain Sister Uncle But And So Yes No Perhaps Today Yesterday Maybe Until".split()
CAPS = "Hash Map Thread Pool Linked List Array Deque Quick Start Release Notes Design Review Machine Learning Data Lake Load Balancer Open Source Best Practice Unit Test Null Pointer Byte Order Kind Regards Dear Team Style Guide Change Log Priority Queue Sparse Matrix Event Loop Red Black Binary Tree Status Report Work Item Virtual Machine Garbage Collector Java Python Apache Spark Monday Friday March October Please Note The This When Use See Add Fix Update Never Always Some Every".split()

_SYL = "ba ke lin mor sal tun ver dro fel gan hul jor mik nas pel rud sta tor vel wen zan chi oda ri esh kov ach".split()
_TAIL = ["son", "sen", "ez", "ov", "ova", "ski", "mann", "ic", "ini", "ian", "wood", "berg", "ton", "ley", "", "", ""]

TRAIN = """{N} opened the ticket.|Thanks to {N} for the report.|Author: {N} <{E}>|Signed-off-by: {N} <{E}>|Please call {T} {P}.|My phone is {P}, ask for {N}.|cc {E}|Write to {E} for access.|{N} lives at {A}.
Ship it to {A}.|Address: {A}|SSN {I} was in the log.|Passport number: {I}|The form of {N} shows {I}.|Regards,\n{N}\n{P}|-- \n{N}\n{A}\nT {P}|From: "{N}" <{E}>|Reviewed by {N}, {N} and {N}.|Dr. {N} said no.|Mr {N} asked {T} {N} first.
user = "{E}"|owner={N}|tel: {P}|fax {P} ext. 44|// TODO({N}): fix|* @author {N}|I met {N} in {W}.|{N} wrote:|Contact {N} ({E}) or {P}.|national id {I}|IBAN {I}|The tax id {I} must go.|He moved to {A} last week.|{N}'s laptop is lost.|"name": "{N}", "phone": "{P}"|name,{N},{P},{E}|Ask {N}. Then wait.|mailto:{E}|Assigned to {N} by {N}.|Danke an {N} für den Hinweis.|Merci à {N}, joignable au {P}.|Gracias a {N} por el aviso.|ID card {I}, issued in {W}|{N} <{E}> wrote on {D}:|Invoice for {A}: paid|born in {W}, now {A}""".replace("\n{", "\0{").replace("\n", "|").replace("\0", "\n").split("|")
#: Any words around the values, so that these are known by their own form.
ANY = """{x} {N} {x}.|{X} {N} {x}|{X} {N}, {x}.|{N} {x}.|{N}, {x}|{x} {N} and {N} {x}|{N} and {N}|({N}) {x}|{x}: {N}|{x} {P} {x}|{X} {P}.|{x}={P}|{x} {I} {x}.|{X} {I}|{x} {A}.|{X} {A} {x}|{A}|{x} {E} {x}|{x}={E}|{N}|{X}, {N}""".split("|")
HELD = """Could {N} look at this?|Reported-by: {N} <{E}>|Reach {N} on {P} after six.|Our office moved to {A}.|Her insurance number is {I}.|Best wishes, {N}|send logs to {E} please|The customer {N} complained.|password reset for {E}|whatsapp {P}|document no {I} leaked|Delivered to {A} on {D}.|Hello {N}, thanks!|maintainer: {N} ({E})|Mrs {N} signed.|{N} and {N} disagree.|// ask {N}|callback={P}""".split("|")
PLAIN = """The {w} {v} after the {w} {v}.|See version {V} of {C}.|{C} {v} on {D}.|Open {C} in port {n}.|ISBN 978-{d}-{d}{d}-{d}{d}{d}{d}{d}{d}-{d}|at 10.{n}.{d}.{n} the {w} {v}|commit {h}|{C} and {C} share one {w}.|git clone git@github.com:acme/{w}.git|ssh git@{w}.internal|@Override public void {w}()|from {w} import {w}|ticket {K}|lines {n}-{n} of {w}.java|{n} of {n} {w}s at {n}.{d} %|on {D} at {d}{d}:{d}{d}|pip install {w}=={V}|{C}: {C}|id {h}-{d}{d}{d}|{w}.{w}({n}, {n});|{x} {C} {x}.|{X} {x}, {x}|{X} {C} {x}|{C}, {x}|The {C} is not the {C}.|meet at noon near the {w}|order {K} costs {n}.{d}{d}|{w} at {w} dot|New in {W}: the {w} {v}.|uuid {h}-{n}-{n}""".split("|")


def _part(items: list[str], held_out: bool) -> list[str]:
    return [x for i, x in enumerate(items) if (i % 3 == 2) == held_out]


class Maker:
    """Makes texts with a seeded generator; ``held_out`` takes the other third of all lists and other sentences."""

    def __init__(self, seed: int, held_out: bool = False) -> None:
        self.r = random.Random(seed)
        self.given, self.family, self.towns, self.streets, self.stems, self.roads = (_part(x, held_out) for x in (GIVEN, FAMILY, TOWNS, STREETS, STEMS, ROADS))
        self.marked, self.any, self.invent = (HELD, HELD, 0.0) if held_out else (TRAIN, ANY, 0.35)

    def digits(self, form: str) -> str:
        return re.sub("[#9@]", lambda m: self.r.choice("0123456789" if m[0] == "#" else "123456789" if m[0] == "9" else "ABCDEFGHJKLMNPRSTUVWXYZ"), form)

    def invented(self, n: int) -> str:
        r = self.r
        w = ("".join(r.choice(_SYL) for _ in range(r.randint(1, n))) + r.choice(_TAIL)).capitalize()
        return w if len(w) > 2 else w + "en"

    def one(self, items: list[str], n: int) -> str:
        return self.invented(n) if self.r.random() < self.invent else self.r.choice(items)

    def name(self) -> str:
        r, g, f = self.r, self.one(self.given, 2), self.one(self.family, 3)
        if r.random() < 0.08:
            f = f"{f}-{self.one(self.family, 2)}"
        if r.random() < 0.05:
            f = r.choice(["van ", "de ", "von ", "van der ", "Di ", "La "]) + f
        i = r.choice("ABCDEFGHIJKLMNOPRSTVW")
        k = r.random()
        out = f"{g} {f}" if k < 0.6 else f"{g} {i}. {f}" if k < 0.68 else f"{f}, {g}" if k < 0.76 else f"{i}. {f}" if k < 0.86 else f"{g} {f[0]}." if k < 0.91 else f"{i}. {r.choice('ABCDEFG')}. {f}" if k < 0.93 else f"{g} {f}"
        return out.upper() if k >= 0.93 else out

    def phone(self) -> str:
        return self.digits(self.r.choice(["###-###-####", "(###) ###-####", "+1 ### ### ####", "+1-###-###-####", "+1.###.###.####", "###.###.####", "1-9##-###-####", "020 #### ####", "07### ######", "+44 7### ######", "+44 20 #### ####", "(0##) #### ####", "+49 30 #######", "+49 (0)89 ##### ###", "030 ########", "0171/#######", "+33 # ## ## ## ##", "0# ## ## ## ##", "+34 ### ### ###", "9# ### ## ##", "+91 ##### #####", "+86 1## #### ####", "+81-#-####-####", "0#### ######", "+41 44 ### ## ##", "+353 1 ### ####"]))

    def id_number(self) -> str:
        return self.digits(self.r.choice(["###-##-####", "### ## ####", "###.##.####", "#########", "@@#######", "@########", "@@######@", "@@ ## ## ## @", "########@", "########-###@", "######-####", "#### #### ####", "9 ## ## ## ### ### ##", "GB## @@@@ #### #### #### ##", "DE## #### #### #### #### ##", "FR## #### #### #### #### #### ###", "@##@##@##", "@@@######@"]))

    def email(self) -> str:
        r = self.r
        g, f = (re.sub("[^a-z]", "", self.one(x, 2).lower()) or "ab" for x in (self.given, self.family))
        local = r.choice([f"{g}.{f}", f"{g}", f"{g[0]}{f}", f"{f}{r.randint(1, 99)}", f"{g}_{f}", f"{f}-{g}", f"{g}+{r.choice(WORDS)}", f"{f}_{r.randint(1, 9)}", f"{g}{f[0]}"])
        host = [r.choice([*WORDS, "mail", "example", "company", f, "uni"])] + ([r.choice(["mail", "dept", "corp"])] if r.random() < 0.3 else []) + [r.choice(["com", "org", "net", "de", "co.uk", "io", "edu", "fr"])]
        k = r.random()
        out = f"{local}@{'.'.join(host)}" if k < 0.7 else f"{local}{r.choice([' at ', ' (at) ', ' [at] ', '(at)', '[at]'])}{'.'.join(host) if k > 0.85 else ' dot '.join(host).replace('.', ' dot ')}"
        return out.upper() if r.random() < 0.1 else out

    def address(self) -> str:
        r, k, no = self.r, self.r.random(), str(self.r.randint(1, 2400))
        town, street = self.one(self.towns, 3), self.one(self.streets, 2)
        if k < 0.5:
            road = r.choice("Street St. St Road Rd Rd. Avenue Ave Lane Drive Dr Boulevard Blvd Court Way Place Square Terrace Crescent Row Close".split())
            house = r.choice([no, f"{no[:3]}{r.choice('ABCab')}"] if r.random() < 0.3 else [no])
            flat = r.choice(["", "", "", "Flat 3, ", f"Apt {r.randint(1, 60)}, ", f"Unit {r.randint(1, 9)}B, "])
            after = r.choice(["", "", "", f", Apt {r.randint(1, 40)}", " NW", f", Suite {r.randint(100, 900)}"])
            code = r.choice(["", "", self.digits(" #####"), self.digits(", @@ #####"), self.digits(" @@# #@@"), self.digits(", @# #@@"), self.digits(", @@@ ####")])
            return f"{flat}{house} {street} {road}{after}, {town}{code}"
        if k < 0.72:
            stem = self.one(self.stems, 2)
            return f"{stem}{r.choice(['straße', 'strasse', 'weg', 'gasse', 'platz', 'allee', 'str.', 'ring'])} {no[:3]}{r.choice(['', '', 'a'])}, {self.digits('#####')} {town}"
        road = self.one(self.roads, 2)
        if k < 0.86:
            return f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Via', 'Paseo', 'Rua'])} {road} {no[:3]}, {r.choice([self.digits('#####') + ' ', ''])}{town}"
        return f"{no[:3]}{r.choice(['', ' bis', ','])} {r.choice(['rue', 'avenue', 'boulevard', 'place', 'Rue'])} {r.choice(['de la ', 'du ', '', 'de '])}{road}, {self.digits('#####')} {town}"

    def fill(self, sentence: str) -> tuple[str, Marks]:
        r, out, marks, n = self.r, [], [], 0
        kinds = {"N": ("name", self.name), "E": ("email", self.email), "P": ("phone", self.phone), "I": ("id_number", self.id_number), "A": ("address", self.address)}
        other = {
            "T": lambda: r.choice(["me", "Dr.", "Mr", "Mrs.", "Herr", "Frau", "us at", "me on"]), "W": lambda: self.one(self.towns, 3), "w": lambda: r.choice(WORDS), "v": lambda: r.choice(VERBS), "V": lambda: self.digits("#.##.#"), "n": lambda: str(r.randint(1, 999)),
            "d": lambda: str(r.randint(0, 9)), "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(7, 12))), "K": lambda: self.digits("@@@-###-##"), "D": lambda: self.digits("20##-0#-1#"),
            "x": lambda: " ".join(r.choice(FILL if r.random() < 0.7 else WORDS) for _ in range(r.randint(1, 4))), "X": lambda: r.choice(LEADS if r.random() < 0.7 else FILL).capitalize(),
            "C": lambda: " ".join(r.choice(CAPS) for _ in range(r.randint(1, 3))),
        }
        for piece in re.split(r"(\{\w\})", sentence):
            key = piece[1:2] if piece[:1] == "{" else ""
            text = kinds[key][1]() if key in kinds else other[key]() if key in other else piece
            if key in kinds:
                marks.append((n, n + len(text), kinds[key][0]))
            out.append(text)
            n += len(text)
        return "".join(out), marks

    def text(self, sentences: int = 8) -> tuple[str, Marks]:
        r, out, marks, n = self.r, [], [], 0
        lead = r.choice(["", "", "", " * ", "// ", "# ", "> "])
        for _ in range(r.randint(2, sentences)):
            k = r.random()
            t, m = self.fill(r.choice(self.marked if k < 0.25 else self.any if k < 0.45 else PLAIN))
            if not m and r.random() < 0.12:
                t = t.upper()
            if lead:
                if "\n" in t:
                    continue
                t, m = lead + t, [(a + len(lead), b + len(lead), k) for a, b, k in m]
            t += r.choice([" ", "\n", "\n\n"]) if not lead else "\n"
            marks += [(a + n, b + n, k) for a, b, k in m]
            out.append(t)
            n += len(t)
        return "".join(out), marks


def score(found: list[Marks], gold: list[Marks]) -> dict[str, tuple[float, float, int]]:
    """(recall, precision, number) of each kind, spans being right if they are equal."""
    out = {}
    for kind in ("email", "phone", "id_number", "address", "name"):
        f = {(i, *m) for i, marks in enumerate(found) for m in marks if m[2] == kind}
        g = {(i, *m) for i, marks in enumerate(gold) for m in marks if m[2] == kind}
        out[kind] = (len(f & g) / max(1, len(g)), len(f & g) / max(1, len(f)), len(g))
    return out
