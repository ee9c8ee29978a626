"""Ordinary sentences with personal values, written apart from the training table; values stand between « and », with their type behind a bar.

TUNED was looked at while the field's features were chosen, FRESH was written afterwards and measured once.
"""

import re

TUNED = """
Yesterday «Margaret Holloway|name» left her umbrella in our waiting room, so I phoned her at «(415) 555-2671|phone».
Hello, could someone get back to me? I'm on «+44 7700 900123|phone» most evenings, or drop a line to «m.holloway@example.co.uk|email».
The lease was countersigned by «Tobias Reinhardt|name» and covers the flat at «27 Larkspur Crescent|address».
Please update your records: my new place is «114 Wexford Avenue|address», Springfield.
Dr. «Okonkwo|name» will see you on Tuesday at 3 pm in room 214.
Applicant's SSN is «219-09-9999|ssn», date of birth 12/04/1981.
Her National Insurance number, «QQ 12 34 56 C|ssn», was missing from the payslip.
Border control noted passport «K04512987|passport» as expired.
Bitte senden Sie die Unterlagen an «Katrin Vogelsang|name», «Lindenstraße 45|address», 50674 Köln.
Sie erreichen mich unter «0171 5551234|phone» oder per Mail an «k.vogelsang@beispiel.de|email».
Mon numéro est le «06 12 34 56 78|phone», demandez «Mathilde Perrin|name».
Nous habitons au «18 rue des Cerisiers|address» depuis mars.
Mi número es «612 345 678|phone» y vivo en «Calle de la Luna 12|address».
El DNI «12345678Z|ssn» figura a nombre de «Rosario Fuentes|name».
mail me: «jordan [at] example [dot] com|email»
you can email «jordan (at) example (dot) com|email» if the form is broken
The quarterly figures from Harrow Logistics Ltd were 4,512 units at 19.99 each.
Order 88231904 was delayed; ticket 55-20918 is still open.
We stayed near Hyde Park and visited the Louvre Museum before flying to New York.
The Apollo Max 3 charger with part number 4471-220-X stopped working.
License plate aside, his driver's license number «D1234567|driver_license» had expired in May.
Mrs. «Adelaide Finch|name» paid in cash, receipt 20931.
Invoice 2023-0456 totals 312.50 EUR, due on 15 March.
the package for «priya raman|name» should go to «9 Old Mill Lane|address»
Cheers,
«Oskar Lindqvist|name»
«+46 70 123 45 67|phone»
Our supervisor, «Helen Castellano|name», approved batch 77120 on Friday.
Emergency contact: «Samuel Adeyemi|name», «555-867-5309|phone».
Send the contract to «legal.team@northwind.example|email» before noon.
I spoke with «Fatou Diallo|name» about the leak at «56 Harbour Road|address», Apt 3.
«Beatrice van Houten|name» reviewed chapter 12 and liked it.
The score was 21-17 after 48 minutes and 1,200 fans stayed.
Ms. «Yamamoto|name» and Mr. «Delacroix|name» disagreed about the budget.
Version 10.4.2 shipped to 3500 customers on 2024-02-11.
Mr «Ferreira|name» wohnt jetzt in der «Goethestraße 8|address».
Reach «Ximena Cordero|name» by phone, «212.555.0198|phone», any weekday.
The Victoria Line was closed, so we walked along Baker Street to Regent's Park.
Ich habe mit «Jonas Feldmann|name» gesprochen; seine Steuer-ID lautet «86 095 742 719|ssn».
Green Valley Foods bought two machines from Turner & Sons for 80,000 dollars.
My old passport no. was «512034789|passport», the new one is in the mail.
Call the clinic at «1-800-555-0144|phone» and quote reference 771204.
"""

FRESH = """
When the boiler failed, «Eleanor Whitcombe|name» rang the landlord on «07911 123456|phone» and left a message.
Shipping label: «Marcus Dunleavy|name», «88 Thornbury Drive|address», Leeds.
Prof. «Nakagawa|name» moved the exam to Friday; questions go to «exam.office@campus.example|email».
Can you resend the invoice to «accounts at brightwater dot org|email»?
Our records show SSN «078-05-1120|ssn» for this employee.
Frau «Bergmann|name» hat die Wohnung in der «Kastanienallee 12|address» gekündigt.
Monsieur «Chevalier|name» attend votre appel au «01 44 55 66 77|phone».
La reunión es en «Avenida del Parque 101|address» con «Leonor Quintana|name».
Passport number «X1234567|passport» was issued in 2019.
He renewed his driving licence «MORGA657054SM9IJ|driver_license» last week.
She lives at «301 Juniper Court|address», just behind the bakery.
Call or text «646-555-0173|phone», no calls after nine please.
I think «Dorothy Pemberton|name» and «Walter Ainsley|name» both voted against it.
Meet me outside Central Library at 18:30, bring 2 copies of form 1040.
Ticket 4410982 was merged into 4410990 by the Data Platform team.
The Northern Star Hotel charges 145.00 per night, breakfast excluded.
Lot 20231107 of the Silver Peak tea was recalled by Morrow Brothers Ltd.
Write «nina_kowal77@post.example.net|email» or ring «(02) 9876 5432|phone».
"""


def parsed(text: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of each line."""
    rows = []
    for line in text.strip().split("\n"):
        out, spans = "", []
        for part in re.split(r"(«[^»]*»)", line):
            if part.startswith("«"):
                value, kind = part[1:-1].rsplit("|", 1)
                spans.append((len(out), len(out) + len(value), kind))
                out += value
            else:
                out += part
        rows.append((out, spans))
    return rows
