"""The small labelled table from which problem 6's field is trained: sentences with marked values, made from public conventions.

Values are made from the published forms of each kind: national telephone plans, identity numbers, passports and licences, postal address orders, and the ways in which
e-mail addresses are disguised. Sentences are cues and carriers in six languages, and counter-examples: numbers, firms, products and places that are no values. Words
around a value are drawn at random from common words and invented ones, so that the field learns from shapes and cues instead of fixed neighbours.

In a sentence a slot of capitals, such as <NAME> or <PHONE>, is a value of that type; one of small letters is not. All values are invented.
"""

from __future__ import annotations

import math
import random
import re

#: Common given and family names of several countries; the name lists of the query are added.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony
Emma Olivia Noah Liam Sophie Chloe Oliver Harry Amelia Grace Hans Klaus Jürgen Petra Sabine Ursula Heike Stefan Wolfgang Anja Lukas Leonie Pierre Jean Marie Camille Léa Hugo Élodie Benoît Aurélie
Luc Antoine Juan José María Carmen Lucía Pablo Javier Sofía Andrés Pilar João Ana Tiago Inês Paulo Beatriz Giulia Marco Luca Chiara Paolo Francesca Olga Ivan Dmitri Natasha Piotr Agnieszka
Ahmed Fatima Omar Layla Youssef Priya Rahul Anjali Arjun Deepa Wei Ming Hiroshi Yuki Kenji Min-jun Ingrid Sven Astrid Erik Freja Niamh Sean Ciara Owen Rhys""".split()
FAMILY = """Smith Johnson Williams Brown Jones Garcia Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young King Wright Scott Hill Green
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf Neumann Dubois Durand Leroy Moreau Lefebvre Fournier Girard Bonnet Rousseau Lambert
Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Romero Torres Silva Santos Oliveira Pereira Costa Rossi Russo Ferrari Bianchi Ricci Ivanov Petrov Kowalski Nowak Novák Horváth
Khan Ahmed Hassan Patel Sharma Singh Gupta Kumar Chen Wang Zhang Liu Tanaka Suzuki Sato Kim Park Nguyen Tran Andersson Johansson Nielsen Hansen Olsen Murphy O'Brien Kelly MacDonald Campbell Stewart""".split()
#: Endings of family names, for invented ones.
ENDINGS = "son sen man mann ton ley field worth well ford ham wood land berg stein bach feld hoff er ner ler et ault eau ier ard ez es os as ini elli etti oni ano ov ev in ski sky wicz ic vic escu idis ström dahl lund gren".split()
FIRST, MIDDLE = "B Br C Cr D Dr F Fl G Gr H J K Kr L M N P Pr R S Sch St T Tr V W Z".split(), "a e i o u ae au ei ie ar el in on ur and ess ill om urt av ed".split()

TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Miss", "Mr", "Mrs", "Ms", "Dr", "Professor", "Sir", "Judge", "Captain"]
TITLES_OF = {"fr": ["M.", "Mme", "Mlle", "Monsieur", "Madame"], "de": ["Herr", "Frau", "Herrn", "Dr."], "es": ["Sr.", "Sra.", "señor", "señora", "Don", "Doña"], "pt": ["Sr.", "Sra.", "senhor", "senhora", "Dona"], "it": ["Sig.", "Signora", "Signor", "Dott."]}

#: Words of carriers: common ones of each language, in which sentences without values are written too.
COMMON = {
    "en": "the a of to in is was for on with that it as at by this had not are but from or have an they which you were all her she there would their we him been has when who will no more if out so what up said about than them can only other time new some could these two may first then do any now my such like our over man me even most made after also did many before must through years where much your way down should because long each just those people".split(),
    "fr": "le la les de des un une et à est en que qui dans pour pas au sur ne se par avec il elle nous vous plus son sa ses ce cette mais comme ou si leur tout bien été fait sans deux aussi après avant très chez encore toujours".split(),
    "de": "der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn".split(),
    "es": "el la los las de que y en un una ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este ir otro ese si me ya ver porque dar cuando muy sin vez mucho saber sobre también hasta hay donde".split(),
    "pt": "o a os as de que e em um uma para com não por mais como mas ao ele das dos se na no foi sua seu ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas".split(),
    "it": "il lo la i gli le di che e un una in per non è con si da come più ma al anche dal nel della ha sono questo alla tutto se mi ci o molto quando dopo senza sempre ancora prima".split(),
}
NOUNS = "coffee train garden printer battery invoice window letter season bridge camera market report kitchen engine doctor teacher driver manager client reviewer neighbour river button filter service update ticket parcel meeting project screen bottle jacket lamp song chapter film museum station update lesson harvest ferry harbour tower cellar stove blanket ladder kettle".split()
VERBS = "moved called broke opened closed sent wrote lost found asked painted cleaned returned fixed shipped tested praised carried measured ignored changed sold bought paid read planned delayed cancelled repaired printed wanted needed brought kept left started finished".split()
#: Nouns of German, which are written with capitals; words that begin sentences, often before a name of a firm, product or place.
NOUNS_DE = "Zug Bahnhof Lampe Rechnung Woche Monat Jahr Kapitel Stadt Haus Zeit Arbeit Kunde Lieferung Batterie Drucker Fenster Geduld Hafen Kaffee Karte Küche Laden Mitte Montag Morgen Nacht Preis Regen Schule Sommer Winter Stück Tag Tisch Weg Wetter Wort Ende Anfang Grund Hand Frage Antwort".split()
OPENERS = {
    "en": "Did Was Has Is Does Can Will Why When Where How After Before With Without In At On From By For Only Last Next Every Each Both Then Now Here There Still Once Since Our My Your Their This That These Two Three Some Most Honestly Yesterday Today According Nobody Everyone Please See".split(),
    "fr": "Avec Sans Dans Pour Après Avant Selon Le La Les Un Une Notre Deux Trois Hier Ensuite Pourquoi Quand Est-ce Chez".split(),
    "de": "Am Im Mit Ohne Nach Vor Bei Der Die Das Dieser Diese Dieses Letzten Nächste Alle Jeder Ein Eine Unser Zwei Drei Gestern Dann Warum Wann Hat Ist Laut Seit Es Man".split(),
    "es": "Con Sin En Para Después Antes Según El La Los Un Una Nuestro Dos Tres Ayer Luego Por Cuando".split(),
}
#: Words that begin sentences before a comma.
ADVERBS = "Honestly Sadly Luckily Finally Suddenly Meanwhile However Therefore Unfortunately Oddly Clearly Frankly Later Well Note Overall Besides Malheureusement Finalement Franchement Attention Enfin Leider Schließlich Achtung Übrigens Endlich Finalmente Sinceramente Además Atención Infelizmente Purtroppo".split()
#: What is numbered.
NUMBERED = "Room Hall Version Chapter Section Gate Page Part Step Level Floor Platform Track Table Row Seat Unit Box Model Type Class Grade Stage Phase Week Day Episode Season Volume Figure Line Route Zone Door Bay Item Batch Sprint Build Release Raum Kapitel Seite Salle Chapitre Capítulo Sala".split()
PLACES = "Garden Park Market Museum Bridge Hotel Bank University Hospital School Theatre Library Airport Station Festival Award Prize Tower Castle Lake Island River Valley Hall Wing Gallery Harbour Beach Arena Stadium College Institute Cathedral Memorial Square Effect Theorem Disease Syndrome Act Treaty Cup Trophy Era Period Railway Line Terminal Quarter Village County".split()
FIRMS = "Ltd Inc. LLC GmbH AG SA Corp. Group & Sons & Co. Brothers Partners LLP Holdings Industries Systems Labs Foods Motors Airlines Insurance Logistics Publishing Records Studios Bakery Pharmacy Books Electronics Software".replace("& ", "&_").split()
THINGS = "Pro Max Plus Mini Ultra Edition Series Model Guide App Suite Player Phone Watch Tablet Kit Engine Console Set Pack Club Catalogue Ledger Express Shuttle Report Weekly Journal Classic".split()
ADJECTIVES = "New Old Great Red Blue Green White Black Silver Golden Royal Northern Southern Eastern Western Central Grand Little Upper Lower Winter Summer Autumn Spring Night Morning Sunday Quiet Open Digital National Public City Smart Happy Deep High First Second Modern River Ocean Mountain Forest".split()
CITIES = "London Paris Berlin Madrid Lisbon Rome Vienna Dublin Boston Chicago Toronto Sydney Mumbai Tokyo Geneva Lyon Hamburg Valencia Porto Milan Leeds Denver Oslo Prague".split()
MONTHS = "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

#: Street words: before the name, after it, or joined to it.
STREET_EN = "Street St St. Avenue Ave Ave. Road Rd Rd. Lane Ln Drive Dr Court Ct Boulevard Blvd Way Place Pl Terrace Close Crescent Square Parkway Circle Highway Row Hill Gardens Mews".split()
STREET_FR = "rue avenue place boulevard bd chemin allée impasse quai route cours passage av.".split()
STREET_ES = "Calle C/ Avenida Avda. Plaza Paseo Camino Carrera Ronda Travesía".split()
STREET_PT, STREET_IT = "Rua Avenida Av. Travessa Praça Largo Alameda Estrada".split(), "Via Viale Piazza Corso Vicolo Largo".split()
STREET_DE, STREET_NL = "straße str. weg allee platz gasse ring damm ufer strasse".split(), "straat laan weg plein gracht kade".split()
ROADS = "Oak Elm Pine Cedar Birch Ash Park Main High Station Church Mill Bridge Castle Green Victoria Albert Queens Kings Washington Lincoln Jackson Franklin Highland Lake River Spring Sunset Forest Meadow Orchard Rose Garden North South East West Market Chapel Grove Hill".split()
ROADS_OF = {"fr": "de la République|Victor Hugo|des Lilas|du Général Leclerc|de Paris|des Roses|du Château|de l'Église|Pasteur|des Peupliers|de la Paix|Jean Jaurès".split("|"), "es": "Mayor|de la Paz|San Juan|del Carmen|de Alcalá|Real|de los Reyes|del Sol|Nueva|de Colón|Santa Ana|del Prado".split("|"), "pt": "das Flores|de São Bento|da Liberdade|do Carmo|Augusta|dos Reis|da Prata|Nova".split("|"), "it": "Roma|Garibaldi|Dante|Mazzini|della Repubblica|Verdi|San Marco|delle Rose".split("|"), "de": "Haupt Bahnhof Schiller Goethe Berg Garten Kirch Wald Rosen Linden Mozart Schul Birken Eichen Buchen Feld Wiesen Markt Burg See".split(), "nl": "Kerk Dorps School Molen Nieuw Wilhelmina Juliana Prinsen Heren Stations".split()}

#: Cues of each type, by language; a cue may be followed by a colon, a word of being, or nothing.
CUES = {
    "EMAIL": {"en": "email|e-mail|Email address|mail|my address is|contact|reach me at|write to|send it to|mailto|reply to|cc|from|you can mail", "fr": "courriel|adresse mail|écrire à|mon e-mail", "de": "E-Mail|Mailadresse|schreib an|per Mail an", "es": "correo|escribe a|mi correo es|correo electrónico", "pt": "e-mail|escreva para|meu correio", "it": "posta|scrivi a|indirizzo email"},
    "PHONE": {"en": "phone|tel|tel.|Telephone|mobile|cell|call|call me on|text|ring|fax|my number is|phone number|hotline|reach us on|dial|whatsapp|contact number|or call", "fr": "tél|téléphone|appelez le|mobile|mon numéro est le|joignable au", "de": "Tel.|Telefon|Handy|ruf an unter|Rufnummer|erreichbar unter", "es": "teléfono|tel.|llama al|móvil|mi número es el", "pt": "telefone|ligue para|telemóvel|celular", "it": "telefono|chiama il|cellulare"},
    "SSN": {"en": "ssn|SSN|social security number|Social Security no.|SS#|national insurance number|NI number|NINO|tax id|national id|identity number|ID card|social insurance number|id number|id", "fr": "numéro de sécurité sociale|n° sécu|numéro INSEE|carte d'identité", "de": "Steuer-ID|Sozialversicherungsnummer|Personalausweis|Ausweisnummer|Steuernummer", "es": "DNI|NIE|NIF|número de identidad|documento de identidad", "pt": "CPF|NIF|bilhete de identidade|RG", "it": "codice fiscale|carta d'identità"},
    "PASSPORT": {"en": "passport|passport number|Passport no.|passport #|passport no|travelling on passport|my passport is", "fr": "passeport|passeport n°|numéro de passeport", "de": "Reisepass|Passnummer|Pass-Nr.|Reisepass Nr.", "es": "pasaporte|pasaporte n.º|número de pasaporte", "pt": "passaporte|passaporte n.º", "it": "passaporto|passaporto n."},
    "DRIVER_LICENSE": {"en": "driver's license|drivers license|driver license|driving licence|driving license|DL|DL#|licence number|driver's licence no.|license no.|licence", "fr": "permis de conduire|permis n°", "de": "Führerschein|Führerschein-Nr.|Führerscheinnummer", "es": "permiso de conducir|carnet de conducir|licencia de conducir", "pt": "carta de condução|CNH|carteira de motorista", "it": "patente|patente n."},
    "ADDRESS": {"en": "address|live at|lives at|living at|located at|ship to|deliver to|send it to|my home is|moved to|at|near|of|visit|home address|billing address|residing at|parcel for", "fr": "adresse|habite au|habite|demeurant au|livrer au|domicilié au", "de": "Adresse|wohnt in der|Anschrift|wohne in der|geliefert an|in der", "es": "dirección|vive en|vivo en|domicilio|enviar a", "pt": "morada|endereço|moro na|vive na", "it": "indirizzo|abita in|vive in"},
    "NAME": {"en": "name|my name is|I am|i am|this is|Customer|Patient|Applicant|contact|signed|Regards,|from|by|Dear|ask for|employee|tenant|with|and|to|for|met|told|author|witness|Name of holder|written by|attn|emergency contact|Hi|Hello|thanks|cheers|best,|yours,|guest|attendee|owner|passenger|buyer|our supervisor,|my neighbour|the plumber,|our accountant|my colleague|her lawyer,|reported by|approved by|countersigned by|spoke with|about|ask|meet|according to|of|left for|driver", "fr": "nom|je m'appelle|demandez|à l'attention de|notre voisin|client|signé|cordialement,|par|avec|chez", "de": "Name|ich heiße|an|Frage an|gesprochen mit|unser Techniker|Kunde|mein Name ist|gezeichnet|von|mit|Kundin|Grüße,", "es": "nombre|me llamo|a nombre de|pregunta por|mi vecino|cliente|firmado|atentamente,|por|con|soy", "pt": "nome|chamo-me|cliente|assinado|por|com", "it": "nome|mi chiamo|cliente|firmato|con"},
}
#: Cues of numbers that are no values.
PLAIN = {"en": "order|Order no.|order number|invoice|Invoice #|ticket|Ticket no.|ref|reference|part|Part no.|part number|batch|lot|serial|serial no.|tracking|tracking number|version|build|page|room|flight|train|item|SKU|case|claim|booking|model|error|code|price|total|only|for|about|article|gate|section|chapter|ISBN|account|policy|meter|job|run|step|sample|sensor|size|weight|bus|row|unit|warehouse|lane|release", "fr": "commande|facture|billet|référence|lot|pièce|page|prix|dossier", "de": "Bestellung|Rechnung|Ticket|Charge|Teil|Seite|Preis|Artikel|Auftrag", "es": "pedido|factura|billete|lote|pieza|página|precio|referencia", "pt": "encomenda|fatura|bilhete|lote|peça|preço", "it": "ordine|fattura|biglietto|lotto|pezzo|prezzo"}
#: Sentences around values of more than one type.
MIXED = """<NAME>, <PHONE>|<NAME> (<PHONE>)|<NAME> <<EMAIL>>|<NAME>, <ADDRESS>|<NAME> - <EMAIL> - <PHONE>|<NAME>; <SSN>; <ADDRESS>|name=<NAME>, phone=<PHONE>, email=<EMAIL>|<NAME>
<ADDRESS>
<city>|<NAME>
<PHONE>|<NAME>
<EMAIL>|<NAME>, <ADDRESS>, <city>|<NAME> of <ADDRESS>|<NAME> and <NAME>|<NAME> or <NAME>|<NAME> with <title> <TITLED>|<NAME>, born <date>, <cue_ssn> <SSN>|<cue_ssn> <SSN>, <cue_address> <ADDRESS>|<cue_phone> <PHONE> or <cue_email> <EMAIL>|<PHONE>, <PHONE>|<EMAIL>, <EMAIL>|<PHONE> / <PHONE>|<EMAIL> and <PHONE>|<NAME> @ <ADDRESS>|<cue_passport> <PASSPORT> (<NAME>)|<cue_driver_license> <DRIVER_LICENSE>, <NAME>|<NAME>, <cue_passport> <PASSPORT>|<ADDRESS>
<n5> <city>|<ADDRESS>, <n5> <city>|<ADDRESS>, <city> <n5>""".split("|")
MIXED = [m for m in MIXED if m.strip()]


class Maker:
    """Values and words by a seeded generator."""

    def __init__(self, seed: int, given: list[str], family: list[str]):
        self.r = random.Random(seed)
        self.given, self.family = [*given, *GIVEN], [*family, *FAMILY]
        self.listed = (given, family)
        self.lang, self.chains = "en", {}

    def pick(self, some):
        return some[int(self.r.random() * len(some))]

    def odd(self, p: float) -> bool:
        return self.r.random() < p

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))

    def form(self, pattern: str) -> str:
        """9 is any digit, A any capital; the rest stands for itself."""
        return "".join(self.digits(1) if c == "9" else self.letters(1) if c == "A" else c for c in pattern)

    def number(self, hi: int) -> str:
        return str(int(math.exp(self.r.random() * math.log(hi))))

    def invented(self) -> str:
        return self.pick(FIRST).lower() + "".join(self.pick(MIDDLE) + self.pick("b c d f g k l m n p r s t v".split()) for _ in range(self.r.randrange(1, 3))) + (self.pick(MIDDLE) if self.odd(0.4) else "")

    def word(self) -> str:
        k = self.r.random()
        if self.lang == "de" and self.odd(0.2):
            return self.pick(NOUNS_DE)
        return self.pick(COMMON[self.lang]) if k < 0.55 else self.pick(NOUNS) if k < 0.7 else self.pick(VERBS) if k < 0.8 else self.invented()

    def opener(self) -> str:
        """Words with capitals that begin a sentence or stand in it, and are no names."""
        first = self.pick(OPENERS.get(self.lang, OPENERS["en"])) if self.odd(0.8) else self.pick(ADVERBS) + ","
        after = self.pick(NOUNS_DE) if self.lang == "de" and self.odd(0.6) else self.invented().capitalize() if self.odd(0.4) else getattr(self, self.pick(["product", "firm", "city", "place"]))() if self.odd(0.4) else self.word()
        return f"{first} {after}"

    def numbered(self) -> str:
        return f"{self.pick(NUMBERED)}{self.pick([' ', ' ', ' ', ' no. ', ' #'])}{self.pick([self.number(99), self.number(999), self.form('9.9'), self.form('9.9.9'), self.form('9') + 'A', self.form('999999999'), self.form('9999999')])}" + (self.pick(["-X", "-A", "/2", "b"]) if self.odd(0.1) else "")

    def bare(self) -> str:
        """A code or number with nothing that tells what it is."""
        return self.form(self.pick(["AA-9999", "A9999", "AA-999", "A999A", "A-9999", "999.99", "99.99", "9999", "99999", "9.99", "AAA-999", "A99", "99-9999", "9999-99", "999", "999.9", "A9-99", "9A9A", "AA999"]))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randrange(lo, hi + 1)))

    # names
    def alike(self, names: list[str]) -> str:
        """A new name whose letters follow each other as in the given ones."""
        if id(names) not in self.chains:
            chain: dict[str, list[str]] = {}
            for w in names:
                for a, b, c in zip("^^" + w, "^" + w, w + "$"):
                    chain.setdefault(a + b, []).append(c)
            self.chains[id(names)] = chain
        for _ in range(20):
            out, chain = "^^", self.chains[id(names)]
            while len(out) < 14 and (c := self.pick(chain[out[-2:]])) != "$":
                out += c
            if 5 <= len(out) < 14 and out[2:].isalpha():
                return out[2:].capitalize()
        return self.invented().capitalize()

    def surname(self) -> str:
        k = self.r.random()
        one = self.pick(self.family) if k < 0.45 else (self.pick(FIRST) + self.pick(MIDDLE) + (self.pick("b c d f g k l m n p r s t v".split()) if self.odd(0.5) else "") + self.pick(ENDINGS)) if k < 0.7 else self.alike(FAMILY) if k < 0.92 else self.invented().capitalize()
        return one + ("-" + self.pick(self.family) if self.odd(0.08) else "")

    def given_name(self) -> str:
        k = self.r.random()
        return self.pick(self.given) if k < 0.55 else self.alike(GIVEN) if k < 0.85 else self.invented().capitalize()

    def NAME(self) -> str:
        g, f, k = self.given_name(), self.surname(), self.r.random()
        if k < 0.12:
            return f"{f}, {g}"
        if k < 0.22:
            return f"{g} {self.letters(1)}. {f}"
        if k < 0.27:
            return f"{g} {self.given_name()} {f}"
        if k < 0.30:
            return f"{g} {self.pick(['de', 'van', 'von', 'da', 'van der', 'del', 'di'])} {f}"
        if k < 0.33:
            return f"{g} {f} {self.surname()}"
        return f"{g} {f}"

    def TITLED(self) -> str:
        k = self.r.random()
        return self.surname() if k < 0.55 else f"{self.letters(1)}. {self.surname()}" if k < 0.65 else f"{self.given_name()} {self.letters(1)}. {self.surname()}" if k < 0.75 else f"{self.given_name()} {self.surname()}"

    def title(self) -> str:
        return self.pick(TITLES_OF.get(self.lang, TITLES)) if self.odd(0.7) else self.pick(TITLES)

    # e-mail
    def EMAIL(self) -> str:
        plain = lambda w: re.sub(r"[^a-z0-9]", "", w.lower().replace("é", "e").replace("ü", "u").replace("ö", "o").replace("ä", "a")) or "x"
        g, f = plain(self.given_name()), plain(self.surname())
        local = self.pick([f"{g}.{f}", f"{g}{f}", f"{g[0]}.{f}", f"{g[0]}{f}", f"{g}_{f}", f"{g}-{f}", f"{f}.{g}", f"{g}{self.digits(2)}", f"{g}.{f}{self.digits(2)}", f"{g}+{plain(self.pick(NOUNS))}", f"{f}", plain(self.pick(NOUNS)), f"{g}.{f}+{plain(self.pick(NOUNS))}", f"{g}{self.digits(4)}", f"{self.invented()}_{self.digits(3)}"])
        name = self.pick(["example", "mail", plain(self.pick(NOUNS)), self.invented(), f"{self.invented()}-{self.pick(NOUNS)}", f"mail.{self.invented()}", f"{self.invented()}.co"])
        host = f"{name}.{self.pick(['com', 'org', 'net', 'de', 'fr', 'es', 'uk', 'io', 'edu', 'test', 'info', 'invalid', 'it'])}"
        k = self.r.random()
        spoken = lambda s, dot: s.replace(".", dot)
        out = f"{local}@{host}"
        if k < 0.30:
            at = self.pick([" at ", " AT ", "(at)", " (at) ", "[at]", " [at] ", " @ ", "＠", " {at} ", " _at_ ", "@ ", " @", " -at- ", " chez ", " arroba "])
            dot = self.pick([" dot ", " DOT ", "(dot)", " (dot) ", "[dot]", " [dot] ", ".", " . ", ".", " punto ", " {dot} "])
            out = f"{spoken(local, dot) if dot.strip('. ') and self.odd(0.4) else local}{at}{spoken(host, dot)}"
        return out.upper() if self.odd(0.07) else out.title() if self.odd(0.03) else out

    # telephone: the plans' own groupings, and any grouping behind + and a country's number
    def PHONE(self) -> str:
        p = self.pick(["(999) 999-9999", "999-999-9999", "999.999.9999", "9999999999", "999 999 9999", "999 999-9999", "1-999-999-9999", "+1 999 999 9999", "+1 (999) 999-9999", "+1-999-999-9999", "+19999999999", "001 999 999 9999", "(999)999-9999", "1 (999) 999-9999",
                       "099 9999 9999", "09999 999999", "+44 99 9999 9999", "+44 9999 999999", "0999 999 9999", "(099) 9999 9999", "09999 999 999", "+44 (0)99 9999 9999",
                       "099 99999999", "099/9999999", "0999-999999", "+49 99 99999999", "+49 999 9999999", "099 99999 999", "+49 99 99999-999", "+49 (0)99 9999999", "0999/99999-99", "09999 / 99999",
                       "09 99 99 99 99", "09.99.99.99.99", "+33 9 99 99 99 99", "0999999999", "+33999999999", "09-99-99-99-99",
                       "999 99 99 99", "99 999 99 99", "+34 999 999 999", "+34 999 99 99 99", "999 999 999", "+351 999 999 999", "+39 999 999 9999", "09 9999 9999",
                       "+61 9 9999 9999", "+91 99999 99999", "+86 999 9999 9999", "+55 99 99999-9999", "(99) 99999-9999", "+31 9 99999999", "+41 99 999 99 99", "+353 99 999 9999", "099-9999-9999", "+81 99 9999 9999"])
        if self.odd(0.2):
            sep = self.pick([" ", "-", ".", " ", "/"])
            p = "+" + "9" * self.r.randrange(1, 4) + sep + sep.join("9" * self.r.randrange(2, 5) for _ in range(self.r.randrange(2, 5)))
        out = self.form(p)
        return out + (self.pick([" ext. ", " ext ", " x", " Ext. "]) + self.digits(self.r.randrange(2, 5)) if self.odd(0.06) else "")

    def SSN(self) -> str:
        return self.form(self.pick(["999-99-9999", "999 99 9999", "999.99.9999", "999999999", "999-99-9999", "999-99-9999", "AA 99 99 99 A", "AA999999A", "AA 999999 A", "99999999A", "99999999-A", "A9999999A", "A-9999999-A", "9 99 99 99 999 999 99", "9999999999999", "99 999 999 999", "99999999999", "999.999.999-99", "9999 9999 9999", "999999-9999", "756.9999.9999.99", "999-999-999", "999 999 999", "AAAAAA99A99A999A", "99.999.999", "99.99.99-999.99"]))

    def PASSPORT(self) -> str:
        return self.form(self.pick(["A9999999", "AA9999999", "A99999999", "999999999", "99AA99999", "A99A99A99", "AA999999", "AAA999999", "A 9999999", "AA 9999999"]))

    def DRIVER_LICENSE(self) -> str:
        return self.form(self.pick(["A9999999", "999999999", "A99999999999", "A999-9999-9999", "AAAAA999999AA9AA", "99999999", "A999999999", "A99AA99999", "AA999999A", "A99-99-9999", "AA-99-99-999", "99-999-9999"]))

    def house(self) -> str:
        return self.number(999) + (self.pick("abcdA B".replace(" ", "")) if self.odd(0.12) else "") + ("-" + self.number(99) if self.odd(0.02) else "")

    def ADDRESS(self) -> str:
        lang = self.lang if self.odd(0.8) else self.pick(["en", "fr", "de", "es", "pt", "it", "nl"])
        n = self.house()
        if lang == "fr":
            return f"{n}{self.pick([' ', ', ', ' bis '])}{self.pick(STREET_FR)} {self.pick(ROADS_OF['fr']) if self.odd(0.6) else self.pick(['des ', 'du ', 'de la ', '']) + self.invented().capitalize()}"
        if lang in ("es", "pt", "it"):
            kind = self.pick({"es": STREET_ES, "pt": STREET_PT, "it": STREET_IT}[lang])
            road = self.pick(ROADS_OF[lang]) if self.odd(0.6) else self.pick(["", "de ", "del ", "da "]) + self.invented().capitalize()
            return f"{kind} {road}{self.pick([', ', ' ', ', nº ', ' n. '])}{n}"
        if lang in ("de", "nl"):
            stem = self.pick(ROADS_OF[lang]) if self.odd(0.6) else self.invented().capitalize()
            join = self.pick(STREET_DE if lang == "de" else STREET_NL)
            return f"{stem}{join} {n}" if self.odd(0.8) else f"{self.invented().capitalize()}er {join.capitalize()} {n}"
        road = self.pick(ROADS) if self.odd(0.5) else self.invented().capitalize() if self.odd(0.7) else f"{self.pick(ROADS)} {self.pick(ROADS)}"
        if self.odd(0.12):
            road = self.pick(["1st", "2nd", "3rd", "5th", "42nd", "N.", "W.", "East", "West"]) + ("" if self.odd(0.4) else " " + road)
        flat = self.pick([", Apt ", ", Apt. ", " Apt ", ", Unit ", ", Suite ", " #", ", Flat "]) + self.number(90) + ("B" if self.odd(0.2) else "") if self.odd(0.15) else ""
        return f"{n} {road} {self.pick(STREET_EN)}{flat}"

    # what is no value
    def firm(self) -> str:
        head = self.surname() if self.odd(0.5) else self.invented().capitalize() if self.odd(0.5) else f"{self.pick(ADJECTIVES)} {self.pick(THINGS)}"
        return f"{head} {self.pick(FIRMS).replace('_', ' ')}"

    def place(self) -> str:
        k = self.r.random()
        head = self.pick(self.given) if k < 0.3 else self.surname() if k < 0.5 else self.pick(ADJECTIVES) if k < 0.75 else self.invented().capitalize()
        return f"{head} {self.pick(PLACES)}" if self.odd(0.85) else f"{self.pick(ADJECTIVES)} {self.invented().capitalize()}"

    def street(self) -> str:
        """A street without a house number."""
        return f"{self.pick(ROADS) if self.odd(0.5) else self.pick(self.given) if self.odd(0.3) else self.invented().capitalize()} {self.pick(['Street', 'Avenue', 'Road', 'Lane', 'Square'])}"

    def product(self) -> str:
        head = self.pick(ADJECTIVES) if self.odd(0.35) else self.invented().capitalize() if self.odd(0.7) else self.pick(self.given)
        return f"{head} {self.pick(THINGS)}" + (f" {self.number(30)}" if self.odd(0.3) else "") if self.odd(0.8) else f"{self.pick(ADJECTIVES)} {self.pick(NOUNS).capitalize()}"

    def city(self) -> str:
        return self.pick(CITIES) if self.odd(0.5) else self.invented().capitalize()

    def date(self) -> str:
        return self.pick([self.form("2099-09-99"), self.form("99/99/2099"), f"{self.number(28)} {self.pick(MONTHS)} {self.form('2099')}", f"{self.pick(MONTHS)} {self.number(28)}", self.form("99.99.2099")])

    def n5(self) -> str:
        return self.digits(5)

    def code(self) -> str:
        return self.form(self.pick(["9999999", "999999999", "99999999", "9999999999", "99999", "9999", "999", "AA-9999", "A999A", "AA999999", "A-99999", "999-999999", "99-9999", "9999-9999-9999", "99-999-999", "999-99-999", "AAA-99-9999", "#99999", "9.9.9", "99.9.999", "2099-99999", "AA9999999", "9A99", "999999-A", "99999-9", "999/99", "99999999999", "978-9-999-99999-9", "999-9999", "9AA-999", "9999 999", "99 99 99"]))

    def price(self) -> str:
        return self.pick([self.form("99.99"), self.form("9,999.99"), "$" + self.form("99"), self.form("99") + " €", self.form("999") + " USD", "£" + self.form("9.99"), self.form("9.999,99") + " EUR", "@ " + self.form("99") + " each"])

    def measure(self) -> str:
        return self.pick([self.form("99.9") + " kg", self.form("99") + " %", self.form("9999x999"), self.form("99:99"), self.form("9") + " x " + self.form("99") + " cm", self.form("99.999.9.99"), self.form("999 999") + " rows", self.form("99-99"), self.form("9:9"), self.form("99°99'"), self.form("99") + " out of " + self.form("99"), self.form("999 9 99") + " units", self.form("99.9") + " to " + self.form("99.9"), "@" + self.invented(), "#" + self.invented(), self.form("9") + " lane", self.form("99 99")])


def _sentence(m: Maker) -> list[tuple[str, str | None]]:
    """Parts of a sentence, each with the type that it is a value of."""
    m.lang = m.pick(["en"] * 6 + ["fr", "de", "es", "es", "fr", "de", "pt", "it"])
    parts: list[tuple[str, str | None]] = []
    cue = lambda cues: m.pick(cues.get(m.lang, cues["en"]).split("|") if m.odd(0.8) else cues["en"].split("|"))
    joint = lambda: m.pick([" ", " ", " ", ": ", ":", " is ", " = ", "=", " – ", " #", " no. ", " (", ", "])

    def text(s: str) -> None:
        parts.append((s, None))

    def value(kind: str) -> None:
        if kind == "NAME" and m.odd(0.3):
            text(m.title() + " ")
            parts.append((m.TITLED(), "name"))
        else:
            parts.append((getattr(m, kind)(), kind.lower()))

    def plain() -> None:
        kind = m.pick(["code", "code", "price", "measure", "date", "firm", "place", "street", "product", "city", "place", "firm", "product", "numbered", "numbered", "bare", "bare"])
        if kind == "bare" and m.odd(0.5):
            text("(" + m.bare() + ")")
            return
        if kind in ("code", "price", "measure") and m.odd(0.75):
            text(cue(PLAIN) + (" " + m.pick(NOUNS + ["run", "id", "copy", "list", "file", "code", "number"]) if m.odd(0.3) else "") + m.pick([" ", " ", " ", ": ", " #", " no. ", " = ", " of "]))
        text(getattr(m, kind)())

    def carrier(lo: int, hi: int) -> str:
        if m.odd(0.35):
            return m.opener() + (" " + m.words(1, hi) if m.odd(0.8) else "")
        w = m.words(lo, hi)
        return w[:1].upper() + w[1:] if m.odd(0.8) else w

    k = m.r.random()
    kinds = ["EMAIL", "PHONE", "SSN", "PASSPORT", "DRIVER_LICENSE", "ADDRESS", "NAME", "NAME", "NAME", "PHONE", "ADDRESS", "EMAIL"]
    if k < 0.38:  # a value behind its cue, perhaps inside a sentence
        kind = m.pick(kinds)
        if m.odd(0.5):
            text(carrier(1, 5) + " ")
        c = cue(CUES[kind])
        if m.odd(0.6 if not parts else 0.15):
            c = c[:1].upper() + c[1:]
        bare = kind in ("NAME", "EMAIL", "PHONE", "ADDRESS") and m.odd(0.1)
        j = "" if bare else joint() if not c.endswith(",") else m.pick([" ", "\n"])
        text(("" if bare else c) + j)
        value(kind)
        text(")" if j == " (" else "")
        if m.odd(0.6):
            text(m.pick([" ", " ", ", ", "; ", " – ", "\n"]) + m.words(1, 6))
    elif k < 0.56:  # names, numbers and addresses without a cue
        kind = m.pick(["NAME", "NAME", "NAME", "NAME", "PHONE", "EMAIL", "ADDRESS"])
        if m.odd(0.45):
            text(carrier(1, 6) + " ")
        value(kind)
        text(m.pick([" ", " ", " ", ", ", "'s "]) + (m.pick(VERBS) + " " if m.odd(0.6) else "") + m.words(1, 7))
        if m.odd(0.3):
            text(m.pick([" ", ", ", " at ", " from ", " and "]))
            plain()
    elif k < 0.70:
        if m.odd(0.4):
            text(carrier(1, 4) + " ")
        for p in re.split(r"(<\w+>)", m.pick(MIXED)):
            if not re.fullmatch(r"<\w+>", p):
                text(p)
            elif p[1:5] == "cue_":
                text(cue(CUES[p[5:-1].upper()]))
            elif p == "<TITLED>":
                parts.append((m.TITLED(), "name"))
            elif p[1:-1].isupper():
                value(p[1:-1])
            else:
                text(getattr(m, p[1:-1])())
        if m.odd(0.4):
            text(m.pick([" ", ", ", "; "]) + m.words(1, 5))
    else:  # no value at all
        for i in range(m.r.randrange(1, 4)):
            if m.odd(0.7):
                text(carrier(1, 6) if not i else m.words(1, 6))
                text(m.pick([" ", " ", " ", ", ", " (", ": "]))
            plain()
            text(m.pick([" ", " ", ", ", " and ", "; "]) + (m.pick(VERBS) + " " if m.odd(0.4) else ""))
        text(m.words(1, 6))
    text(m.pick([".", ".", ".", ".", "!", "?", "", ";", "…"]))
    return parts


def labelled(given: list[str], family: list[str], sentences: int = 14_000, seed: int = 6) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of a few sentences with the spans (start, past, type) of their values; some in lower or upper case."""
    m = Maker(seed, given, family)
    out = []
    while sentences > 0:
        text, spans = "", []
        for _ in range(m.r.randrange(1, 4)):
            sentences -= 1
            if text:
                text += m.pick([" ", " ", " ", "\n", "\n\n"])
            for s, kind in _sentence(m):
                if kind:
                    spans.append((len(text), len(text) + len(s), kind))
                text += s
        k = m.r.random()
        changed = text.lower() if k < 0.12 else text.upper() if k < 0.17 else text
        out.append((changed if len(changed) == len(text) else text, spans))
    return out
