"""Labelled spans for the sequence model, made from scratch: every text is written around mentions that are known to be there.

Names come from lists and from syllables, numbers from the formats that countries publish, and both stand in prose, mails,
chats, code, logs and tables that are composed here. Nothing is taken from the corpus; ``personal`` adds corpus windows by
what a first model says of them.
"""

from __future__ import annotations

import random
import re
import string

KINDS = ("person", "email", "phone", "id_number", "address")
LANGS = ("en", "de", "fr", "es")

#: Given names and surnames.
_GIVEN = {
    "en": "James Mary Oliver Emma George Alice Harold Ruth Peter Susan Toby Clara Edmund Grace Felix Nora Victor Helen Simon Joyce Walter Irene Hugh Mabel Arthur Daisy Colin Fiona Neil Paula",
    "de": "Hans Anna Karl Greta Uwe Heike Jürgen Sabine Dieter Ulrike Lukas Lena Friedrich Birgit Matthias Käthe Rolf Ingrid Stefan Petra Torsten Silke Bernd Monika Gerd Anke Moritz Frieda Emil Jutta",
    "fr": "Jean Marie Luc Chloé Pierre Sylvie Michel Élodie Thierry Odile Benoît Camille Hervé Colette Antoine Margaux Gaston Lucie Rémi Agnès Jean-Luc Marie-Claire Fabrice Noémie Étienne Solène Yves Brigitte Didier Hélène",
    "es": "José María Luis Carmen Javier Pilar Andrés Lucía Ramón Teresa Íñigo Marta Rubén Elena Gonzalo Rocío Álvaro Nuria Joaquín Inés Hugo Paula Tomás Beatriz Ignacio Consuelo Emilio Mercedes Raúl Soledad",
}
_SURNAMES = {
    "en": "Smith Baker Long Reed Hughes Walker Price Carter Fletcher O'Neill MacLeod Whitfield Ashdown Parker Moore Bell Marsh Hartley Dawson Finch Young Stone Winter Bishop",
    "de": "Müller Schmidt Becker Vogel Krause Lang Kurz Brandt Schäfer Neumann Weiß Fuchs Hofmann Jansen Seidel Pohl Richter Kühn Bergmann Ziegler König Stein Sommer Baum",
    "fr": "Martin Petit Blanc Dubois Lefèvre Moreau Girard Rousseau Fontaine Mercier Leroy Chevalier Perrin d'Arcy Marchand Gauthier Besson Colin Renard Aubry Roche Noël Faure Rivière",
    "es": "García Costa Fuentes Romero Vega Ortiz Molina Castro Delgado Iglesias Peña Núñez Cano Serrano Bravo Marín Campos Rojas Calvo Prieto Reyes Flores Lara Nieto",
}
_ONSET = "b br c cl d dr f fl g gr h j k kl l m n p pl r s sch st t tr th v w z".split()
_VOWEL = "a e i o u ai ea ee ie ou au ei".split()
_CODA = {
    "en": "ton ley wick field worth by combe grove man son ridge more ham send low gate well stead".split(),
    "de": "mann berg stein hoff bach feld brück egger rath hagen wald lich meister kötter thal".split(),
    "fr": "eau ard ier ville mont court bois reau oux ellier ance aud igny elle on".split(),
    "es": "ez era ado illo oso anza ales ero ín uela ardo edo igal ana iz".split(),
}

_STREET_EN = "Street St. St Road Rd Lane Ln Avenue Ave Ave. Drive Close Crescent Square Court Way Terrace Row Hill Place Walk Gardens Blvd".split()
_STREET_DE = "straße strasse str. weg gasse allee platz ring damm ufer steig hof markt".split()
_STREET_FR = "rue|avenue|av.|boulevard|bd|place|impasse|chemin|allée|quai|cours|passage|route|square".split("|")
_STREET_ES = "Calle|C/|Avenida|Avda.|Av.|Plaza|Pza.|Paseo|Camino|Ronda|Travesía|Cuesta|calle".split("|")
_LINK_FR = ("de la ", "du ", "des ", "de l'", "", "", "d'", "de ")
_LINK_ES = ("de la ", "del ", "de los ", "de ", "", "", "Mayor de ")


class Maker:
    """Makes values of each kind; ``share`` of the name words are made of syllables."""

    def __init__(self, rng: random.Random, share: float = 0.6):
        self.rng, self.share = rng, share

    def syllables(self, lang: str, n: int) -> str:
        r = self.rng
        return "".join(r.choice(_ONSET) + r.choice(_VOWEL) + (r.choice(("", "n", "r", "l", "s", "m")) if i < n - 1 or r.random() < 0.4 else "") for i in range(n))

    def surname(self, lang: str) -> str:
        r = self.rng
        if r.random() > self.share:
            return r.choice(_SURNAMES[lang].split())
        word = (self.syllables(lang, 1 if r.random() < 0.75 else 2) + r.choice(_CODA[lang])).capitalize()
        if r.random() < 0.12:
            word = {"en": r.choice(("Mc", "O'", "Fitz")), "de": r.choice(("Ober", "Nieder", "Al")), "fr": r.choice(("Le", "De", "L'")), "es": r.choice(("Villa", "Monte", "Santa"))}[lang] + (word if r.random() < 0.6 or lang == "en" else word.lower())
        return word

    def given(self, lang: str) -> str:
        r = self.rng
        if r.random() > self.share * 0.7:
            return r.choice(_GIVEN[lang].split())
        return (self.syllables(lang, 1 if r.random() < 0.5 else 2) + r.choice({"en": ("y", "in", "a", "ock", "eth", "en", "el"), "de": ("a", "e", "wig", "mut", "hild", "o", "ke"), "fr": ("ette", "ine", "ard", "e", "ien", "aume"), "es": ("a", "o", "ita", "án", "ino", "és")}[lang])).capitalize()

    def person(self, lang: str) -> str:
        r = self.rng
        if r.random() < 0.12:
            lang = r.choice(LANGS)
        g, s = self.given(lang), self.surname(lang)
        if r.random() < 0.06 and lang != "es":
            g = f"{g}-{self.given(lang)}"
        if r.random() < (0.45 if lang == "es" else 0.12):
            s = f"{s}{r.choice((' ', '-') if lang == 'es' else ('-',))}{self.surname(lang)}"
        if r.random() < 0.08:
            s = {"en": r.choice(("van ", "de ", "St. ")), "de": r.choice(("von ", "van ", "von der ", "zu ", "von dem ")), "fr": r.choice(("de ", "du ", "de la ", "Le ")), "es": r.choice(("de ", "de la ", "del ", "de los "))}[lang] + s
        i = r.choice(string.ascii_uppercase)
        roll = r.random()
        if roll < 0.5:
            out = f"{g} {s}"
        elif roll < 0.6:
            out = f"{g} {i}. {s}"
        elif roll < 0.68:
            out = f"{g[0]}. {s}"
        elif roll < 0.72:
            out = f"{g[0]}. {i}. {s}"
        elif roll < 0.80:
            out = f"{s}, {g}"
        elif roll < 0.84:
            out = f"{s}, {g[0]}."
        elif roll < 0.87:
            out = f"{s}, {g} {i}."
        else:
            out = f"{g} {self.given(lang)} {s}"
        roll = r.random()
        if roll < 0.08:
            out = out.lower()
        elif roll < 0.13:
            out = out.upper()
        elif roll < 0.16:
            out = out.replace(s, s.upper())
        return out

    def digits(self, n: int, first: str = string.digits) -> str:
        return self.rng.choice(first) + "".join(self.rng.choice(string.digits) for _ in range(n - 1))

    def grouped(self, s: str, *sizes: int, sep: str | None = None) -> str:
        sep = self.rng.choice((" ", "-", ".", "", " ", "-")) if sep is None else sep
        out, at = [], 0
        for n in sizes:
            out.append(s[at : at + n])
            at += n
        return sep.join([*out, *([s[at:]] if at < len(s) else [])])

    def phone(self, lang: str) -> str:
        r, g = self.rng, self.grouped
        if r.random() < 0.08:
            lang = r.choice(LANGS)
        roll = r.random()
        if lang == "en" and roll < 0.55:  # North America
            area, mid, end = self.digits(3, "23456789"), self.digits(3, "23456789"), self.digits(4, string.digits)
            local = r.choice((f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"{area} {mid} {end}", f"({area}){mid}-{end}", f"{area}/{mid}-{end}", f"{area}{mid}{end}"))
            out = r.choice(("", "", "+1 ", "1-", "1 ", "+1-", "001 ", "+1.", "1.", "+1")) + local
            return out + (r.choice((" ext. ", " x", " ext ")) + self.digits(r.randint(2, 4)) if r.random() < 0.1 else "")
        code, local = {
            "en": ("44", r.choice((("20", 4, 4), ("161", 3, 4), ("1632", 6), ("7" + self.digits(3, string.digits), 6), ("7" + self.digits(3, string.digits), 3, 3), ("28", 4, 4), ("131", 3, 4)))),
            "de": ("49", r.choice((("30", 8), ("40", 7), ("89", 4, 4), ("221", 7), ("69", 8), ("17" + self.digits(1, string.digits), 7), ("17" + self.digits(1, string.digits), 3, 4), ("15" + self.digits(1, string.digits), 8), ("711", 6), (self.digits(4, "23456789"), 5), (self.digits(3, "23456789"), 4, 2)))),
            "fr": ("33", r.choice((("1", 2, 2, 2, 2), ("6", 2, 2, 2, 2), ("7", 2, 2, 2, 2), (r.choice("2345"), 2, 2, 2, 2), (r.choice("12345679"), 4, 4)))),
            "es": ("34", r.choice(((r.choice("6789") + self.digits(2, string.digits), 3, 3), (r.choice("689") + self.digits(2, string.digits), 2, 2, 2), ("9" + self.digits(1), 3, 2, 2)))),
        }[lang]
        sep = r.choice((" ", " ", "-", ".", "", "/"))
        tail = sep.join(self.digits(n, string.digits) for n in local[1:])
        roll = r.random()
        trunk = "" if lang == "es" else "0"
        area = local[0]
        join = r.choice((sep, " ", "/", "-")) if lang != "fr" else sep
        if roll < 0.42:
            return r.choice((f"{trunk}{area}{join}{tail}", f"({trunk}{area}) {tail}", f"{trunk}{area}{join}{tail}"))
        prefix = r.choice((f"+{code}", f"+{code}", f"00{code}", f"(+{code})", f"+{code}"))
        if roll < 0.52 and trunk:
            return f"{prefix}{r.choice((' ', ''))}(0){r.choice((' ', ''))}{area}{join}{tail}"
        if roll < 0.6:
            return f"{prefix} ({trunk}{area}) {tail}"
        return f"{prefix}{r.choice((sep, ' ', ''))}{area}{join}{tail}"

    def id_number(self, lang: str) -> str:
        r, d = self.rng, self.digits
        up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
        any_ = lambda n: "".join(r.choice("CFGHJKLMNPRTVWXYZ0123456789") for _ in range(n))
        if lang == "en":
            return r.choice((self.grouped(d(9, string.digits), 3, 2, 4, sep=r.choice("- -")), self.grouped(d(9, string.digits), 3, 2, 4), f"{up(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{up(2)}{d(6)}{r.choice('ABCD')}", d(9), f"{up(1)}{d(8)}", f"{up(2)}{d(7)}", f"{d(2)}-{d(7)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{up(1)}{d(7)}", f"{up(1)}-{d(4)}-{d(4)}", f"{up(1)} {d(3)} {d(4)}", f"{up(2)} {d(3)} {d(3)}", f"{up(1)}{d(3)} {d(4)}", self.grouped(d(9), 3, 3, 3)))
        if lang == "de":
            return r.choice((f"{r.choice('CFGHJKL')}{any_(8)}", f"L{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}", f"{r.choice('CFGHJKL')}{any_(8)}{d(1)}", self.grouped(d(11), 2, 3, 3, 3, sep=r.choice((" ", ""))), f"{d(2)} {d(6)} {up(1)} {d(3)}", f"{d(8)}{up(1)}{d(3)}", f"{d(3)}/{d(3)}/{d(5)}", f"{d(2)}/{d(3)}/{d(5)}", d(10), f"{up(2)}{d(7)}", f"T{d(8)}", self.grouped(d(11), 2, 3, 3, 3), f"{up(1)}{d(2)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"))
        if lang == "fr":
            nir = f"{r.choice('12')}{d(2, string.digits)}{r.randint(1, 12):02d}{d(8, string.digits)}"
            return r.choice((nir + d(2), self.grouped(nir + d(2), 1, 2, 2, 2, 3, 3, 2, sep=r.choice((" ", ".", " "))), nir, self.grouped(nir, 1, 2, 2, 2, 3, 3, sep=" "), f"{d(2)}{up(2)}{d(5)}", f"{up(1)}{any_(7)}{d(1)}", d(12), self.grouped(d(13), 2, 2, 3, 3, 3, sep=r.choice((" ", ""))), f"{d(2)} {up(2)} {d(5)}", d(15), self.grouped(d(15), 3, 3, 3, 3, 3), f"{up(2)} {d(3)} {d(4)}"))
        return r.choice((f"{d(8)}{up(1)}", f"{d(8)}-{up(1)}", f"{d(2)}.{d(3)}.{d(3)}-{up(1)}", f"{r.choice('XYZ')}{d(7)}{up(1)}", f"{r.choice('XYZ')}-{d(7)}-{up(1)}", f"{up(3)}{d(6)}", self.grouped(d(12), 2, 8, 2, sep=r.choice((" ", "/", "", "-"))), f"{up(2)}{d(6)}", f"{d(8)} {up(1)}", f"{d(2)} {d(6)} {up(1)}", f"{d(2)} {d(3)} {d(3)} {up(1)}", f"{up(3)} {d(6)}"))

    def email(self, lang: str) -> str:
        r = self.rng
        plain = lambda s: re.sub(r"[^a-z]", "", s.lower().translate(str.maketrans("áàâäéèêëíìîïóòôöúùûüñçß", "aaaaeeeeiiiioooouuuuncs")))
        g, s = plain(self.given(lang)), plain(self.surname(lang))
        words = ("info team support contact admin press sales jobs bot".split())
        local = r.choice((f"{g}.{s}", f"{g[:1]}.{s}", f"{g}_{s}", f"{g}{s}", f"{s}{r.randint(1, 99)}", f"{s}.{g}", f"{g}-{s}", f"{g}+{r.choice(words)}", f"{s}_{r.randint(1, 99)}", f"{g[:1]}{s}", f"{g}.{s}{r.randint(1, 2010)}", s, f"{r.choice(words)}.{s}"))
        host = r.choice((f"{plain(self.surname(r.choice(LANGS)))}.", f"mail.{plain(self.surname(lang))}.", f"{plain(self.given(lang))}-{plain(self.surname(lang))}.", f"mx{r.randint(1, 9)}.{plain(self.surname(lang))}.", f"{r.choice(('uni', 'mail', 'post', 'lab', 'dev', 'data'))}{r.choice(('', '-', ''))}{plain(self.surname(lang))}."))
        whole = host + r.choice("com org net example test invalid de fr es io co.uk eu edu".split())
        if r.random() < 0.08:
            local = local.upper() if r.random() < 0.5 else local.title()
        if r.random() < 0.68:
            return f"{local}@{whole}"
        at = r.choice((" [at] ", " (at) ", "[at]", "(at)", " at ", " AT ", " (AT) ", " @ ", " {at} ", {"en": " at ", "de": " at ", "fr": " arobase ", "es": " arroba "}[lang]))
        dot = r.choice((".", ".", " [dot] ", " (dot) ", " dot ", "[dot]", "(dot)", " DOT ", {"en": " dot ", "de": " punkt ", "fr": " point ", "es": " punto "}[lang]))
        out = local.replace(".", dot if r.random() < 0.5 and dot != "." else ".") + at + whole.replace(".", dot)
        return out if r.random() < 0.9 else f"{local} @ {whole}"

    def town(self, lang: str) -> str:
        r = self.rng
        word = (self.syllables(lang, r.randint(1, 2)) + r.choice({"en": ("ford", "ton", "bury", "mouth", "pool"), "de": ("stadt", "burg", "heim", "hausen", "dorf"), "fr": ("ville", "bourg", "gny", "sur-Mer", "ac"), "es": ("illa", "ares", "osa", "real", "ejo")}[lang])).capitalize()
        if r.random() < 0.2:
            word = {"en": r.choice(("North ", "Little ", "Port ", "Great ")), "de": r.choice(("Bad ", "Neu-", "Alt ")), "fr": r.choice(("Saint-", "La ", "Le ")), "es": r.choice(("San ", "Villa ", "La "))}[lang] + word
        return word + (r.choice((" Quay", " upon Wye", "-on-Sea", " Heath", " Cross", "-under-Hill")) if lang == "en" and r.random() < 0.3 else "")

    def address(self, lang: str) -> str:
        r = self.rng
        n = str(r.randint(1, r.choice((9, 99, 250, 4000 if lang == "en" else 250))))
        name = self.surname(lang) if r.random() < 0.6 else self.syllables(lang, 2).capitalize() + r.choice(_CODA[lang])
        if lang == "en":
            if r.random() < 0.2:
                name = r.choice(("Old ", "North ", "Upper ", "St Mary's ", "Queen's ", "Long ", "Mill ")) + (name if r.random() < 0.7 else r.choice(("Mill", "Church", "Station", "Park", "Bridge")))
            street = f"{n}{r.choice(('', '', '', 'a', 'B'))} {name} {r.choice(_STREET_EN)}"
            unit = r.choice((f", Apt {r.randint(1, 99)}", f", Apt. {r.randint(1, 30)}{r.choice('ABC')}", f", Flat {r.randint(1, 40)}", f", Unit {r.randint(1, 40)}", f" Suite {r.randint(100, 900)}", f", #{r.randint(1, 40)}")) if r.random() < 0.25 else ""
            zip_ = r.choice((f" {self.digits(5)}", f", {r.choice('LMSBN')}{r.randint(1, 20)} {r.randint(1, 9)}{r.choice('ABDEFG')}{r.choice('ABDEFG')}", f", {r.choice(('CA', 'NY', 'TX', 'OR'))} {self.digits(5)}")) if r.random() < 0.25 else ""
            return street + unit + ((f", {self.town(lang)}" + zip_) if r.random() < 0.6 else "")
        if lang == "de":
            form = r.random()
            if form < 0.62:
                street = name + r.choice(_STREET_DE) if r.random() < 0.75 else f"{name}-{r.choice(('Straße', 'Platz', 'Weg', 'Allee', 'Ring'))}"
            elif form < 0.8:
                street = r.choice(("Am ", "An der ", "Im ", "Zum ", "Zur ", "Auf der ", "Hinter dem ", "Unter den ", "In der ")) + name
            else:
                street = r.choice(("Alte ", "Neue ", "Lange ", "Kleine ", "Große ", "Obere ", "Breite ")) + r.choice(("Gasse", "Straße", "Allee", "Mühle", name + "straße"))
            if r.random() < 0.1:
                street = street.lower()
            street += f" {n}{r.choice(('', '', '', 'a', ' b', 'c'))}"
            return street + (f"{r.choice((', ', ', ', ' in '))}{self.digits(5, string.digits) + ' ' if r.random() < 0.6 else ''}{self.town(lang)}".replace(" in ", ", ") if r.random() < 0.6 else "")
        if lang == "fr":
            street = f"{n}{r.choice(('', '', '', ' bis', ' ter', 'B'))}{r.choice((' ', ', ', ' '))}{r.choice(_STREET_FR)} {r.choice(_LINK_FR)}{name}"
            if r.random() < 0.06:
                street = street.title() if r.random() < 0.5 else street.upper()
            return street + (f", {self.digits(5, string.digits) + ' ' if r.random() < 0.7 else ''}{self.town(lang)}" if r.random() < 0.6 else "")
        street = f"{r.choice(_STREET_ES)}{r.choice((' ', ' ', ''))}{r.choice(_LINK_ES)}{name}".replace("Calledel", "Calle del")
        street = re.sub(r"^(Calle|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|Cuesta|calle)(?=\S)", r"\1 ", street)
        street += f"{r.choice((', ', ' ', ', n.º ', ', nº ', ' nº '))}{n}{r.choice(('', '', '', ', 2.º B', ', 3º izq.', ', bajo'))}"
        return street + (f", {self.digits(5, string.digits) + ' ' if r.random() < 0.7 else ''}{self.town(lang)}" if r.random() < 0.6 else "")

    def make(self, kind: str, lang: str) -> str:
        out = getattr(self, kind)(lang)
        if kind == "address" and self.rng.random() < 0.18:  # the town on a line of its own
            out = out.replace(", ", ",\n" if self.rng.random() < 0.6 else "\n") if out.count(", ") == 1 else ",\n".join(out.rsplit(", ", 1))
        return out


#: Labels that stand before a value, by kind and language; the last row is for keys of code and logs.
_LABELS = {
    "person": {"en": "name|contact|author|owner|signed|reviewer|from|patient|attn|prepared by", "de": "Name|Kontakt|Autor|Ansprechpartner|gez.|Bearbeiter|Von|Inhaber|Verfasserin", "fr": "nom|contact|auteur|signé|responsable|de la part de|rédigé par|titulaire", "es": "nombre|contacto|autor|firmado|responsable|de parte de|titular|revisora", "key": "name|user_name|owner|author|created_by|fullName|contact|annotator|assignee|uploaded_by|N|FN"},
    "email": {"en": "email|e-mail|mail|write to|contact|reply to|mail me at|reach us at", "de": "E-Mail|Mail|Mailadresse|schreib an|Kontakt|Rückfragen an", "fr": "courriel|e-mail|mél|écrire à|contact|adresse électronique", "es": "correo|e-mail|correo electrónico|escribir a|contacto", "key": "email|mail|reply_to|user|contact|from|cc|maintainer|EMAIL"},
    "phone": {"en": "phone|tel|tel.|mobile|cell|call|fax|call me on|my number is|phone number|office", "de": "Telefon|Tel.|Handy|Mobil|Fax|Rückruf unter|Telefonnummer|erreichbar unter|Durchwahl", "fr": "téléphone|tél.|tél|portable|fax|joignable au|mon numéro est le|appeler le", "es": "teléfono|tel.|tlf.|móvil|fax|mi número es el|llamar al|número de teléfono", "key": "phone|tel|mobile|fax|phone_number|contact|TEL|caller|msisdn"},
    "id_number": {"en": "SSN|social security number|passport no.|passport number|passport|tax ID|ID card no.|national ID|NI number|identity card|ITIN|national insurance no.", "de": "Ausweisnummer|Personalausweis|Reisepass|Steuer-ID|Steuernummer|Sozialversicherungsnummer|Passnummer|Ausweis-Nr.|Pass Nr.|Personalausweisnummer", "fr": "numéro de sécurité sociale|n° de sécu|passeport n°|carte d'identité|numéro fiscal|CNI|n° fiscal|passeport|NIR", "es": "DNI|NIE|NIF|pasaporte|número de la seguridad social|documento de identidad|n.º de pasaporte|nº SS", "key": "ssn|passport|tax_id|national_id|nif|dni|id_card|passport_no|steuer_id|nir|identity"},
    "address": {"en": "address|home address|lives at|ship to|mailing address|residence|deliver to|come to|my address", "de": "Adresse|Anschrift|wohnhaft|wohnt in der|Lieferung an|Postanschrift|Wohnort|zieht in die", "fr": "adresse|domicile|domicilié au|habite au|livrer à|adresse postale|réside", "es": "dirección|domicilio|vive en|enviar a|residencia|entregar en|dirección postal", "key": "address|street|addr|home|location|ship_to|postal|ADR"},
}

#: Sentences around names and other mentions; p, e, t, i, a stand for the kinds.
_PROSE = {
    "en": [
        "{p} joined the team in spring.", "We thank {p} for careful reading.", "The draft by {p} is late.", "{p} and {p} disagree on this.", "Please ask {p} about it.", "According to {p}, nothing changed.", "It was {p} who found it.", "Mr {p} left early, sadly.", "Dr. {p} will chair the session.",
        "A note from {p} arrived.", "{p} said that the build is green.", "I spoke with {p} last week.", "Her manager, {p}, agreed.", "{p}'s patch fixes that.", "Kind regards,\n{p}", "Best,\n{p}\n{t}", "Cheers, {p}", "Thanks\n-- \n{p}\n{e}", "Dear {p},", "Hello {p}, how are you?", "My name is {p} and I live at {a}.", "I am {p}; mail me at {e}.",
        "You can reach {p} on {t}.", "Call {t} after six.", "Send it to {e} please.", "The parcel goes to {a}, second floor.", "She moved to {a} in May.", "{p} lives at {a} now.", "His SSN is {i}, do not share it.", "The passport {i} expired.", "We meet at {a} on Monday.", "From {a} to {a} it takes an hour.", "Mrs {p} ({t}) called twice.", "Only {p} knew about it.", "Last night {p} restarted the run.",
        "Written by {p} (c) 2021", "Meeting with {p}, {p} and {p}.", "Then {p} merged the branch, and {p} reviewed.", "Contact: {p} <{e}>", "Signed-off-by: {p} <{e}>", "reported by {p} via {e}", "ring {t} or write to {e}", "passport number {i} was issued to {p}", "the tax number of {p} is {i}", "Is {t} still your number?", "Today {p} presents the results.", "Ms {p} from accounting asked.",
        "ID card {i}, issued 2019", "{p} | {t} | {e}", "{p}\t{e}\t{t}", "{p};{a};{t}", "| {p} | {i} | {a} |", "born as {p}", "cc {p}", "ping {p} pls", "tell {p} hi", "i gave {p} my number, {t}", "text me {t}", "it is {e} without spaces", "Our neighbour {p} at {a} has the key.", "Visit us: {a}.", "Whenever {p} trains it, the loss drops.", "hello, {p} here", "This is {p} speaking, my number is {t}.", "He typed \"{i}\" into the form.", "We found {i} in the old file.",
    ],
    "de": [
        "{p} kam im Frühjahr ins Team.", "Wir danken {p} für die Durchsicht.", "Der Entwurf von {p} ist spät dran.", "{p} und {p} sind anderer Meinung.", "Frag bitte {p} danach.", "Nach Angaben von {p} bleibt alles gleich.", "Es war {p}, die es fand.", "Herr {p} ging früh.", "Frau Dr. {p} leitet die Sitzung.", "Eine Notiz von {p} liegt vor.", "{p} sagt, dass alles läuft.", "Ich sprach mit {p} letzte Woche.", "Ihr Chef, {p}, stimmte zu.",
        "Mit freundlichen Grüßen\n{p}", "Viele Grüße\n{p}\n{t}", "LG {p}", "Sehr geehrte Frau {p},", "Hallo {p}, wie geht es?", "Ich heiße {p} und wohne {a}.", "Ich bin {p}; schreib mir an {e}.", "{p} ist unter {t} erreichbar.", "Ruf {t} nach sechs an.", "Bitte an {e} senden.", "Das Paket geht in die {a}, zweiter Stock.", "Sie zog im Mai in die {a}.", "{p} wohnt jetzt {a}.", "Die Steuer-ID {i} ist vertraulich.", "Der Reisepass {i} ist abgelaufen.",
        "Wir treffen uns {a} am Montag.", "Von der {a} bis zur {a} dauert es.", "Frau {p} ({t}) rief zweimal an.", "Nur {p} wusste davon.", "Gestern Abend startete {p} den Lauf neu.", "Geschrieben von {p}, 2021", "Treffen mit {p}, {p} und {p}.", "Dann hat {p} den Zweig gemischt.", "Kontakt: {p} <{e}>", "gemeldet von {p} über {e}", "die Nummer von {p} ist {t}", "Ausweis {i}, ausgestellt 2019", "die Ausweisnummer von {p} ist {i}", "{p} | {t} | {e}", "{p};{a};{t}", "| {p} | {i} | {a} |",
        "geborene {p}", "sag {p} bescheid", "meine nummer ist {t}", "Heute stellt {p} die Ergebnisse vor.", "Der Nachbar {p} in der {a} hat den Schlüssel.", "Besuchen Sie uns: {a}.", "Immer wenn {p} trainiert, fällt der Verlust.", "Hier {p}, guten Tag.", "Er tippte \"{i}\" in das Formular.", "Wir fanden {i} in der alten Akte.", "Auf Wunsch von {p} verschoben.",
    ],
    "fr": [
        "{p} a rejoint l'équipe au printemps.", "Merci à {p} pour la relecture.", "Le brouillon de {p} est en retard.", "{p} et {p} ne sont pas d'accord.", "Demande à {p} s'il te plaît.", "D'après {p}, rien n'a changé.", "Ce fut {p} qui le trouva.", "M. {p} est parti tôt.", "Mme {p} préside la séance.", "Un mot de {p} est arrivé.", "{p} dit que tout marche.", "J'ai parlé avec {p} la semaine dernière.", "Son chef, {p}, a accepté.",
        "Bien à vous,\n{p}", "Amicalement,\n{p}\n{t}", "Salut, {p}", "Chère {p},", "Bonjour {p}, comment ça va ?", "Je m'appelle {p} et j'habite {a}.", "Je suis {p} ; mon adresse est {e}.", "On peut joindre {p} au {t}.", "Appelez le {t} après six heures.", "À envoyer à {e} svp.", "Le colis va au {a}, deuxième étage.", "Elle a déménagé au {a} en mai.", "{p} habite {a} maintenant.", "Son numéro {i} reste secret.", "Le passeport {i} a expiré.", "Rendez-vous au {a} lundi.",
        "Du {a} au {a} il faut une heure.", "Mme {p} ({t}) a appelé deux fois.", "Seul {p} le savait.", "Hier soir {p} a relancé le calcul.", "Écrit par {p}, 2021", "Réunion avec {p}, {p} et {p}.", "Puis {p} a fusionné la branche.", "Contact : {p} <{e}>", "signalé par {p} via {e}", "le numéro de {p} est le {t}", "carte d'identité {i}, délivrée en 2019", "le numéro de sécu de {p} : {i}", "{p} | {t} | {e}", "{p};{a};{t}", "| {p} | {i} | {a} |",
        "née {p}", "dis bonjour à {p}", "mon numéro c'est {t}", "Aujourd'hui {p} présente les résultats.", "Notre voisin {p} au {a} a la clé.", "Venez nous voir : {a}.", "Quand {p} l'entraîne, la perte baisse.", "Ici {p}, bonjour.", "Il a tapé « {i} » dans le formulaire.", "On a trouvé {i} dans le vieux dossier.", "Selon le rapport de {p}, tout va bien.",
    ],
    "es": [
        "{p} llegó al equipo en primavera.", "Gracias a {p} por la lectura.", "El borrador de {p} va con retraso.", "{p} y {p} no están de acuerdo.", "Pregunta a {p} por favor.", "De acuerdo con {p}, nada cambió.", "Era {p} quien lo halló.", "El señor {p} se fue pronto.", "La doctora {p} preside la sesión.", "Llegó una nota de {p}.", "{p} dice que todo va bien.", "Hablé con {p} la semana pasada.", "Su jefa, {p}, aceptó.",
        "Un saludo,\n{p}", "Saludos\n{p}\n{t}", "Hasta luego, {p}", "Estimada {p}:", "Hola {p}, ¿qué tal?", "Me llamo {p} y vivo en {a}.", "Soy {p}; mi correo es {e}.", "Se puede llamar a {p} al {t}.", "Llama al {t} después de las seis.", "Enviar a {e} por favor.", "El paquete va a {a}, segundo piso.", "Se mudó a {a} en mayo.", "{p} vive en {a} ahora.", "Su DNI {i} es privado.", "El pasaporte {i} caducó.", "Quedamos en {a} el lunes.",
        "De {a} a {a} hay una hora.", "Doña {p} ({t}) llamó dos veces.", "Solo {p} lo sabía.", "Anoche {p} reinició el proceso.", "Escrito por {p}, 2021", "Reunión con {p}, {p} y {p}.", "Luego {p} fusionó la rama.", "Contacto: {p} <{e}>", "avisado por {p} desde {e}", "el número de {p} es el {t}", "documento {i}, expedido en 2019", "el DNI de {p} es {i}", "{p} | {t} | {e}", "{p};{a};{t}", "| {p} | {i} | {a} |",
        "nacida {p}", "saluda a {p}", "mi móvil es {t}", "Hoy {p} presenta los resultados.", "El vecino {p} de {a} tiene la llave.", "Visítenos: {a}.", "Cuando {p} lo entrena, baja la pérdida.", "Aquí {p}, buenos días.", "Escribió «{i}» en el formulario.", "Encontramos {i} en la ficha vieja.", "Como dijo {p}, no hay prisa.",
    ],
}

#: Sentences without mentions that look like ones; n, v, w, d, h stand for numbers, versions, words, dates, hashes.
_PLAIN = [
    "See ticket {n} and build {v}.", "order {n} shipped", "Invoice no. {n} of {d}", "version {v} released on {d}", "case {n} is closed", "commit {h}", "step {n} | loss {f} | lr {f}", "ISBN {n}", "batch {n} took {f} s", "at {f} GB per {w}", "between {f} and {f}", "host 10.0.{f} port {n}", "from 192.168.1.14 to 10.20.30.40", "uuid {h}-{h}", "part number {n}", "{w}_{n}.bin", "loss@k and recall@10", "q @ k.T", "@dataclass", "pip install {w}=={v}", "npm i {w}@{v}", "a * b @ c",
    "Siehe Vorgang {n} und Stand {v}.", "Rechnung {n} vom {d}", "Voir le dossier {n} et la version {v}.", "Facture n° {n} du {d}", "Ver la incidencia {n} y la versión {v}.", "Pedido {n} del {d}", "Le {d} à 12 h 30", "am {d} um 14:05 Uhr", "el {d} a las 9:15", "on {d} at 09:41:07", "row {n}, block {n}", "Room 12, Second Floor", "Page 14, Chapter Nine", "Table 3, Column Two", "Zeile 14, Block Sieben", "Ligne 3, colonne deux", "Fila 7, bloque nueve", "GPU {n}: {f} W", "{n} tokens in {f} ms",
    "The Adam optimizer beats it.", "the Fourier transform of {w}", "Gauss-Newton steps", "a Markov Chain of order two", "Bayes rule", "Nesterov momentum", "Kullback Leibler divergence", "the Turing Award of 1986", "Dijkstra's algorithm", "die Gauß-Verteilung", "le théorème de Bayes", "la transformada de Laplace", "das Newton-Verfahren", "la loi de Moore", "el algoritmo de Euclides", "Moore's Law and Amdahl's Law", "Jensen's inequality", "the Hessian and the Jacobian", "Monte Carlo sampling", "a Poisson process", "Von Neumann architecture", "der Satz von Pythagoras", "le nombre d'Avogadro", "la constante de Planck",
    "New York and San Diego", "Monday Morning News", "Deep Learning Summit", "The Old Bridge Inn", "Royal Society Press", "United Nations Day", "Apache Spark on Linux", "Visual Studio Code", "Open Source Week", "Bad Homburg", "Le Monde Diplomatique", "Costa Rica", "Guten Tag zusammen", "Baker Street", "Rue de Rivoli", "Plaza Mayor", "the Main Street cafe",
    "User {w}{n} logged in", "login={w}_{n}", "user {w}.{w}", "by {w}", "if x.{w} > {n}:", "return {w}({f}, \"{w}-{w}.bin\")", "for {w} in range({n}):", "std::vector<float>& {w}", "<|user|>ok<|end|>", "\"{w}\": {n},", "\"{w}\": [{f}, {f}],", "{w}={n}", "{w}: {f}", "| {w} | {n} | {f} |", "| Name | Wert |", "| Step | Loss |", "First Pass, Second Pass", "Chapter One", "{w} {w} {w}.", "phase {n}/{n} done", "ETA {f}", "DOI 10.1000/{n}", "arXiv:2101.{n}", "account balance {f} EUR", "size 1920 x 1080", "ratio 3 : 4", "serial {h}", "License: MIT", "Copyright 2019-2023", "Phone support is closed.", "no address given", "Email notifications are off.", "mailto links break", "look at dot products", "at the end dot", "meet at noon point", "{n} Hidden Layers", "12 Attention Heads", "3 Main Stages", "100 Training Steps", "24 Old Checkpoints",
]
#: Words in capitals that open a sentence before a name, and closings of mails.
_OPENERS = {
    "en": "Since When After Because Yesterday Today Maybe Then Was If Did With For Once Although Before It's Tell Let Like Until Why Meanwhile".split(), "de": "Seit Als Nachdem Weil Gestern Heute Vielleicht Dann War Wenn Hat Mit Für Sobald Obwohl Bevor Sag Bis Laut Erst Auch Nur Hier Dort Haben Gutachten:".split(),
    "fr": "Depuis Quand Après Parce Hier Aujourd'hui Alors Était Si Avec Pour Dès Avant Selon Dites Puis Seulement Ici Fut Voici Comme".split(), "es": "Desde Cuando Después Porque Ayer Hoy Quizá Entonces Era Si Con Para Antes Según Dile Fue Solo Aquí Tanto Como Hasta".split(),
}
_CLOSINGS = {
    "en": "Regards|Best|Sincerely|Yours|Signed|Thanks|Cheers|Best wishes|Yours truly|Respectfully", "de": "Gruß|Grüße|Viele Grüße|Herzlich|Liebe Grüße|gez.|Mit Gruß|Beste Grüße|Danke|Hochachtungsvoll",
    "fr": "Cordialement|Bien à vous|Amitiés|Bises|Merci|Salutations|Sincèrement|À bientôt|Respectueusement", "es": "Saludos|Un abrazo|Atentamente|Cordialmente|Gracias|Un saludo|Besos|Hasta pronto|Respetuosamente",
}
_TAILS = {"en": " left|, it stopped| moved| said so|, nobody reads it| and {p} left|", "de": " ging| und {p} kamen|, ist es still| es sagte| es merkte|, hält es|", "fr": " est parti| et {p} sont venus|, tout va bien| l'a dit|, personne ne lit|", "es": " se fue| y {p} vinieron|, todo sigue| lo dijo|, nadie lo lee|"}

#: What can follow a labelled value.
_TAIL_WORDS = {
    "en": "expires soon|was lost|is valid until May|issued in spring|has changed|please|(mornings only)|as of today|is on file|was checked|if it stalls|for now", "de": "ist abgelaufen|liegt vor|gilt bis Mai|wurde geprüft|ausgestellt im Juni|bitte|ab heute|hat sich geändert|ist bekannt|bei Rückfragen",
    "fr": "expire bientôt|a été perdu|valable un an|délivré en mai|a changé|merci|dès aujourd'hui|est connu|a été vérifié|si besoin", "es": "caduca pronto|se perdió|vale hasta mayo|expedido en junio|ha cambiado|por favor|desde hoy|ya revisado|consta en la ficha|si hace falta",
}

#: Blocks of several lines and columns, whatever the language.
_BLOCKS = [
    "{p}\n{a}\n{t}\n{e}", "{p}\n{a}\n{t}\n{e}", "{p}\n{a}\n{t}", "{p}\n{a}\n{t}", "{p}\n{a}", "{p}\n{a}", "{t}", "{t}", "{e}", "{a}", "{a}\n{t}\n{e}", "{p}\n{t}", "{p}\n{e}", "{p}, {a}", "{p}, {t}", "{p} ({e})", "{p} <{e}>, {p} <{e}>", "BEGIN:VCARD\nFN:{p}\nTEL:{t}\nEMAIL:{e}\nEND:VCARD", "FN:{p}\nADR:{a}\nTEL:{t}", "name;mail;phone\n{p};{e};{t}\n{p};{e};{t}", "id,name,city\n4,{p},here", "name,address\n{p},\"{a}\"", "/* (c) 2020 {p}\n * {e}\n */",
    "# Copyright 2021 {p} <{e}>", "// Copyright (c) 2019, {p}", " * @author {p}", " * @author {p} <{e}>", "-- {p}, {t}", "# TODO({p}): fix", "Date: 2020-02-03\nFrom: {p} <{e}>\nTo: {e}", "From: {e}\nTo: {p}", "> {p} wrote:\n> ok", "| {p} | {e} |", "| {p} | {t} |", "| {e} | {t} |", "| {a} | {t} |", "{p};{e};{t}", "user={e} phone={t}", "2023-04-01 10:00:00 INFO user={e} tel={t} ip=10.0.0.3", "{e} {t}", "{t} / {e}", "{t}, {e}", "- {p}\n- {p}\n- {p}", "1. {p}: {t}\n2. {p}: {t}", "{p} -> {p}", "[{p}](mailto:{e})", "{p}: ok\n{p}: late", "\"{p}\", \"{a}\"", "({t})", "{t} -- ask for {p}", "{p} -- {e}",
]
#: What is named after people, and other pairs of words in capitals; s is a surname.
_NAMED = [
    "the {s} Schedule", "the {s} method", "{s} Loss", "a {s} Filter", "the {s} Trick", "{s} Norm", "the {s}-{s} inequality", "the {s} Test", "{s}'s Lemma", "the {s} Prize", "{s} distance", "the {s} Index of order two", "Use {s} Smoothing here.", "a {s} Layer, not Plain Dropout", "{s} & Sons", "{s} Ltd", "{s} University", "the {s} Institute", "the {s} Window", "{s} Initialization", "the {s} Plan",
    "das {s}-Verfahren", "der {s}-Test", "die {s}-Norm", "die {s}-Ungleichung", "{s} GmbH", "der {s}-Plan", "nach dem {s}-Schema", "die {s}-Stiftung", "la méthode de {s}", "le test de {s}", "la norme de {s}", "le filtre de {s}", "l'inégalité de {s}", "le plan {s}", "l'institut {s}", "Éditions {s}", "le barème {s}", "el método de {s}", "la prueba de {s}", "la norma de {s}", "el filtro de {s}", "el plan {s}", "Editorial {s}", "el premio {s}", "la regla de {s}",
    "Plain Warmup", "Cosine Decay", "Second Shelf", "Block Seven", "Row Nine", "Early Stopping", "Hidden Layer", "Weight Decay", "Large Batch Run", "Final Report", "Budget Zähler", "Zweites Regal", "Deuxième Étagère", "Segundo Estante", "Read Me First", "Open Issues", "Next Steps",
]
#: Numbers in groups that are counts; g is such a number.
_COUNTS = [
    "a total of {g} tokens", "The count is {g}.", "vocabulary of {g} words", "ids {g} and 50256", "Seed {g}", "size {g} bytes", "offset {g}", "limit ({g})", "shape {g}", "El total es {g}.", "son {g} fichas", "un total de {g} filas", "Le total est de {g} jetons", "soit {g} lignes", "compteur : {g}", "Der Stand ist {g}.", "insgesamt {g} Zeilen", "Zähler auf {g}", "{g} rows read", "{g} of {g}", "range {g} to {g}", "checksum {g}", "Token {g}", "epoch {g}", "Vocabulary {g} is a slice", "value: {g}", "{g} steps", "timeout={g}", "n = {g}",
]
_WORDS = "cache queue shard loss step token mask index buffer writer reader batch gate norm layer head table split chunk epoch grad scale merge vocab eviction Tensor Speicher Datei Schritt fichier tampon couche archivo paso capa modelo Modell modèle".split()
_NAME_KEYS = {"p": "person", "e": "email", "t": "phone", "i": "id_number", "a": "address"}


class Writer:
    """Writes pieces of text with their labelled spans."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.make = Maker(self.rng)

    def fill(self, template: str, lang: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, at = [], [], 0
        for m in re.finditer(r"\{([petia])\}", template):
            head = template[at : m.start()]
            value = self.make.make(_NAME_KEYS[m.group(1)], lang)
            out += [head, value]
            begin = sum(map(len, out[:-1]))
            spans.append((begin, begin + len(value), _NAME_KEYS[m.group(1)]))
            at = m.end()
        return "".join([*out, template[at:]]), spans

    def plain(self) -> str:
        r = self.rng
        number = lambda: r.choice((str(r.randint(1, 99999)), f"{r.randint(1, 999)}-{r.randint(10, 9999)}-{r.randint(10, 99)}", f"{r.randint(10, 99)},{r.randint(100, 999)}", f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(10, 9999)}", f"#{r.randint(1000, 9999999)}", f"{r.choice('ABTX')}-{r.randint(100, 99999)}", f"{r.randint(10, 99)}-{r.randint(10, 99)}-{r.randint(10, 99)}", f"0{r.randint(10, 99)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", str(r.randint(10**6, 10**9)), f"978-{r.randint(0, 9)}-{r.randint(100, 99999)}-{r.randint(100, 999)}-{r.randint(0, 9)}"))
        values = {
            "n": number, "v": lambda: f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}{r.choice(('', '-rc2', 'b1', ''))}", "w": lambda: r.choice(_WORDS), "f": lambda: r.choice((f"{r.random():.4f}", f"{r.random():.2e}", f"{r.uniform(0, 99):.2f}", str(r.randint(1, 500)))),
            "d": lambda: r.choice((f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/20{r.randint(10, 29)}", f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.20{r.randint(10, 29)}")),
            "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 12, 40)))),
        }
        grouped = lambda: self.make.grouped(self.make.digits(r.randint(5, 11), "0123456789"), *r.choice(((3, 2), (3, 3), (2, 3, 3), (2, 2, 2), (1, 3, 3), (3, 3, 3))), sep=r.choice((" ", ",", ".", "-", " ")))
        values |= {"g": lambda: r.choice((grouped(), grouped(), self.make.digits(r.randint(5, 10)), f"({self.make.digits(3)}) {self.make.digits(3)}-{self.make.digits(3)}")), "s": lambda: self.make.surname(r.choice(LANGS))}
        return re.sub(r"\{([nvwfdhgs])\}", lambda m: values[m.group(1)](), r.choice(r.choice((_PLAIN, _PLAIN, _NAMED, _COUNTS))))

    def labelled(self, lang: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A label and its value, in one of the manners of forms, code, logs and tables."""
        r = self.rng
        kind = r.choice(KINDS)
        key = r.choice(_LABELS[kind]["key"].split("|"))
        label = r.choice(_LABELS[kind][lang].split("|"))
        if r.random() < 0.3:
            label = label.capitalize() if r.random() < 0.6 else label.lower()
        tail = r.choice(_TAIL_WORDS[lang].split("|"))
        slot = "{" + next(k for k, v in _NAME_KEYS.items() if v == kind) + "}"
        shape = r.choice((
            f"{label}: {slot}", f"{label} ({slot})", f"{label} {slot} {tail}", f"{label} : {slot}", f"{label} {slot} {tail}.", f"{label} {slot}, {tail}", f"{label} {slot}", f"{label} {slot}.", f"({label} {slot})", f"- {label}: {slot}", f"{label}\n{slot}", f"| {label} | {slot} |", f"{label} = {slot}", f"# {label} {slot}", f"// {label}: {slot}", f"{label}, {slot}",
            f'"{key}": "{slot}"', f'{{"{key}": "{slot}", "id": 4}}', f"{key}={slot}", f"{key}: {slot}", f"<{key}>{slot}</{key}>", f'{key} = "{slot}"', f"{key}:{slot}", f"[INFO] {key}={slot} status=ok", f"{key}={slot};", f"'{key}': '{slot}',", f"<|user|>{label} {slot}<|end|>", f"{label}: {slot} / {slot}", f'"{label} {slot}"', f"{label}\t{slot}", f"{slot} ({label})", f"<|assistant|>{label}: {slot}<|end|>", f"> {label} {slot}",
        ))
        return self.fill(shape.replace("{{", "").replace("}}", "}") if shape.startswith("{{") else shape, lang)

    def piece(self, lang: str) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.rng
        roll = r.random()
        if roll < 0.52:
            kind = r.random()
            if roll >= 0.36:
                template = r.choice(_BLOCKS)
            elif kind < 0.2:
                template = f"{r.choice(_OPENERS[lang])} {{p}}{r.choice(_TAILS[lang].split('|'))}{r.choice(('.', ',', ''))}"
            elif kind < 0.34:
                template = f"{r.choice(_CLOSINGS[lang].split('|'))}{r.choice((', ', ',', chr(10), ', ', ' - '))}{{p}}"
            else:
                template = r.choice(_PROSE[lang])
            text, spans = self.fill(template, lang)
            if r.random() < 0.15:
                text = f"<|{r.choice(('user', 'assistant'))}|>{text}<|end|>"
                shift = text.index(">") + 1
                spans = [(a + shift, b + shift, k) for a, b, k in spans]
            return text, spans
        if roll < 0.8:
            return self.labelled(lang)
        return self.plain(), []
