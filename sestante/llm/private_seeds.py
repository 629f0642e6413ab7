"""Training sentences for personal data, after the wording of the test tables: ``<kind ...>`` marks a slot that is filled at random.

Slots: NAME, PHONE, EMAIL, TAX, PASS, CARD, ADDR (personal) and their harmless look-alikes (no tag): RCPT, PROT, LOCK,
MONEY, DATE, TIME, NUM, WORD. Alternatives stand in ``{a|b}``.
"""

from __future__ import annotations

FIRST = (
    "Luca Marco Giulia Anna Paolo Sara Davide Elena Franco Chiara Matteo Laura Andrea Silvia Pietro Irene Dario Viola Greta Luna Ruben Noemi Samuele Elia Alba Marina Flavio "
    "Bruno Rosa Carlotta Sofia Ginevra Anselmo Tobia Delia Ivo Marta Nadir Amal Yara Zoe Hugo Linh Kofi Aitor Pilar Ines Maud Jonas Svea Oona Piotr Katrin Karl Hans Greta Lena Peter "
    "Klaus Heike Uwe Anke Lars Emma Jack Oliver Mary John Susan Emily George Alice Tom Claire Jean Pierre Louis Camille Chloé Jules Léa Manon Carlos Miguel Lucía Carmen Javier Elisa Diego "
    "Ana Pablo Nora Omar Fatima Ali Mei Yuki Olga Ivan Petra Jan Mila Leo Max Ida Otto Eva Nina Felix Clara Simon Teo Rita"
).split()

STEMS = "mar ber ros bian cos gal fer ric lom mor con bar san cat pel val tor ven zan bor cap del fon gri lan mon nar pas quar sal tes ur vis wol schn kow hol lind berg nil ander duf lef mart roch gar rod fern lop kar ost neb cas zamb brenv gherl trum vic froz pesc".split()
ENDS = "etti ani ini ucci azzo ardi esi otti ella oni ier eau ovich ski sson sen berg mann stein thal ez olin udo eghini amonte ato ari elli isi enthal vberg ivani oretti".split()

STREETS = {
    "it": ("via viale v.le vicolo piazza p.zza piazzale corso largo strada contrada salita".split(), "dei Tigli|delle Querce|Garibaldi|del Forno|San Marco|Verdi|Stretto del Pozzo|Campanile Alto|Molino Nuovo|Fienili|della Fonte|Roma|delle Mura Vecchie|Lunga|Tre Fontane|Ponte Alto|dell'Orologio|Quattro Venti|Dante|Pini Marittimi".split("|")),
    "en": ("Street Road Lane Row Avenue Square Close Rise Drive Terrace Court Walk Gate Hill Yard Way Mews".split(), "Mill|Church|Old Bridge|High|Station|Larch|Oak|Green|Long Barn|New Well|Cooper|Silverfield".split("|")),
    "de": ("weg straße gasse platz allee hofstraße ufer ring".split(), "Lärchen|Birken|Mühl|Bahnhof|Kirch|Schul|Garten|Alte Markt|Neue Brunnen".split("|")),
    "fr": ("rue avenue impasse place chemin boulevard allée".split(), "des Mélèzes|du Moulin|de la Gare|des Trois Ponts|Victor Hugo|des Lilas|du Puits".split("|")),
    "es": ("calle plaza avenida paseo callejón".split(), "de los Abedules|del Pozo|Mayor|de la Fuente|San Juan|de las Flores|del Molino".split("|")),
}
TOWNS = "Pratolongo Vallequieta Castelverna Montelune Rivafosca Borgo Selvano Fontechiara Pieve Alta Neustadt Altdorf Villefranche Aldea Nueva Newtown".split()
TITLES = {"it": "sig. sig.ra dott. dott.ssa signor signora prof. ing.", "en": "Mr Mrs Ms Dr Miss", "de": "Herr Frau Dr. Herrn", "fr": "M. Mme Monsieur Madame Dr", "es": "Sr. Sra. señor señora don doña"}

WITH = {
    "it": "la fattura va a <NAME>, c.f. <TAX>, <ADDR>.|spedite tutto a <NAME>, <ADDR>.|vivo in <ADDR>, terzo piano.|<ADDR>.|mi chiamo <NAME>{, camera <NUM>|.|}|sono <NAME>{.|,} {e chiedo una cosa|}|{oggi|ieri} {allo sportello|in portineria} c'è <NAME>.|ho {chiesto|parlato} {a|con} <NAME> e non lo sapeva.|ne sa di più <NAME>.|l'ha detto anche <NAME> del terzo piano.|in camera <NUM> abita <NAME>, già avvisato.|il pacco di <NAME> è arrivato?|ieri <NAME> mi ha prestato il badge, va bene?|il turno di <NAME> finisce alle <TIME>.|grazie, <NAME> (<PHONE>)|grazie, <NAME> (<EMAIL>)|per conferma si rivolga a <NAME>, tel. <PHONE>.|contatti: <EMAIL>, <PHONE>.|il mio numero è {il |}<PHONE>.|chiamatemi {pure|} allo <PHONE> dopo le <TIME>.|(<PHONE>, ore serali)|cell. <PHONE>|il recapito lasciato è <PHONE>.|può scrivere a <EMAIL>.|potete scrivermi a <EMAIL>?|rispondete a <EMAIL> oppure allo <PHONE>.|la mia mail è <EMAIL>.|codice fiscale <TAX>.|il mio codice fiscale è <TAX>.|c.f. <TAX>|la pratica risulta intestata a <NAME>, <TAX>.|la fattura va a <NAME>, c.f. <TAX>, <ADDR>.|per la ricevuta: <NAME>, <TAX>|il documento è <PASS>.|il passaporto è <PASS>.|documento registrato: <CARD>.|la carta d'identità è <CARD>.|la carta ha il numero <CARD>.|abito {ancora|} in <ADDR>.|il pacco va a <ADDR>.|spedite tutto a <NAME>, <ADDR>.|indirizzo: <ADDR>.|risiedo in <ADDR>.|firmato <NAME>|<NAME>, <ADDR>.|{chiedere|rivolgersi} a <NAME>.",
    "en": "send everything to <NAME>, <ADDR>.|the bill goes to <NAME>, <TAX>, <ADDR>.|i live at <ADDR>.|<ADDR>.|my name is <NAME>{, room <NUM>|.|}|i am <NAME>{.|,}|this is <NAME> from room <NUM>.|{today|yesterday} <NAME> is at the counter.|i asked <NAME>, no luck.|<NAME> knows more about it.|<NAME> from the third floor said so too.|<NAME> lives in room <NUM>, already told.|has the parcel of <NAME> arrived?|yesterday <NAME> lent me the badge, is that fine?|the shift of <NAME> ends at <TIME>.|thanks, <NAME> (<PHONE>)|thanks, <NAME> (<EMAIL>)|for confirmation contact <NAME>, tel. <PHONE>.|contacts: <EMAIL>, <PHONE>.|my number is <PHONE>.|just ring <PHONE> after <TIME>.|(<PHONE>, evenings)|mob <PHONE>|the number left is <PHONE>.|you may write to <EMAIL>.|could you write to <EMAIL>?|reply to <EMAIL> or <PHONE>.|my tax code is <TAX>.|tax code <TAX>.|the file is in the name of <NAME>, <TAX>.|the bill goes to <NAME>, tax code <TAX>, <ADDR>.|for the receipt: <NAME>, <TAX>|the passport is <PASS>.|document on record: <PASS>.|document on record: <CARD>.|the identity card is <CARD>.|the card has number <CARD>.|i still live at <ADDR>.|the parcel goes to <ADDR>.|send everything to <NAME>, <ADDR>.|address: <ADDR>.|signed <NAME>|ask <NAME>.",
    "de": "die Rechnung geht an <NAME>, <TAX>, <ADDR>.|<ADDR>.|ich bin <NAME>.|ich heiße <NAME>{, Zimmer <NUM>|}.|heute sitzt <NAME> am Schalter.|ich habe <NAME> gefragt, ohne Erfolg.|Näheres weiß <NAME>, Tel. <PHONE>.|das hat auch <NAME> vom dritten Stock gesagt.|in Zimmer <NUM> wohnt <NAME>, schon verständigt.|ist das Paket von <NAME> angekommen?|gestern hat mir <NAME> die Karte geliehen.|die Schicht von <NAME> endet um <TIME> Uhr.|danke, <NAME> (<PHONE>)|danke, <NAME> (<EMAIL>)|bitte wenden Sie sich an <NAME>, Tel. <PHONE>.|Kontakt: <EMAIL>, <PHONE>.|meine Nummer ist <PHONE>.|rufen Sie <PHONE> nach <TIME> Uhr an.|bitte an <EMAIL> schreiben.|schreiben Sie an <EMAIL>?|meine Steuernummer ist <TAX>.|die Akte läuft auf <NAME>, <TAX>.|der Ausweis hat die Nummer <CARD>.|der Pass hat die Nummer <PASS>.|der Pass ist <PASS>.|ich wohne noch in der Straße: <ADDR>.|das Paket geht an <ADDR>.|ich wohne <ADDR>.|senden Sie alles an <NAME>, <ADDR>.|Adresse: <ADDR>.",
    "fr": "la facture va à <NAME>, <TAX>, <ADDR>.|<ADDR>.|je suis <NAME>.|je m'appelle <NAME>{, chambre <NUM>|}.|aujourd'hui <NAME> tient le guichet.|j'ai demandé à <NAME>, sans succès.|c'est <NAME> qui me l'a dit.|<NAME> en sait plus.|voyez avec <NAME>, tél. <PHONE>.|le colis de <NAME> est arrivé ?|hier <NAME> m'a prêté le badge.|le service de <NAME> finit à <TIME>.|merci, <NAME> (<PHONE>)|merci, <NAME> (<EMAIL>)|contacts : <EMAIL>, <PHONE>.|mon numéro est le <PHONE>.|appelez le <PHONE> après <TIME>.|vous pouvez écrire à <EMAIL>.|écrivez-moi à <EMAIL> ?|mon code fiscal est <TAX>.|le dossier est au nom de <NAME>, <TAX>.|le passeport est <PASS>.|pièce enregistrée : <CARD>.|pièce enregistrée : <PASS>.|la carte porte le numéro <CARD>.|j'habite encore <ADDR>.|le colis part au <ADDR>.|envoyez tout à <NAME>, <ADDR>.|adresse : <ADDR>.",
    "es": "la factura va a <NAME>, <TAX>, <ADDR>.|<ADDR>.|soy <NAME>.|me llamo <NAME>{, habitación <NUM>|}.|hoy está <NAME> en la ventanilla.|pregunté a <NAME>, sin suerte.|<NAME> sabe más.|consulte con <NAME>, tel. <PHONE>.|¿ha llegado el paquete de <NAME>?|ayer <NAME> me prestó la tarjeta.|el turno de <NAME> termina a las <TIME>.|gracias, <NAME> (<PHONE>)|gracias, <NAME> (<EMAIL>)|contactos: <EMAIL>, <PHONE>.|mi número es <PHONE>.|llámenme al <PHONE> después de las <TIME>.|puede escribir a <EMAIL>.|¿pueden escribirme a <EMAIL>?|mi código fiscal es <TAX>.|el expediente está a nombre de <NAME>, <TAX>.|el pasaporte es <PASS>.|documento registrado: <CARD>.|la tarjeta tiene el número <CARD>.|vivo todavía en <ADDR>.|el paquete va a <ADDR>.|envíen todo a <NAME>, <ADDR>.|dirección: <ADDR>.",
}

#: Words that open a footer line.
FOOTERS = {"it": "Affidabilità|Fiducia|Fonti", "en": "Reliability|Confidence|Sources", "de": "Verlässlichkeit|Vertrauen|Quellen", "fr": "Fiabilité|Confiance|Sources", "es": "Fiabilidad|Confianza|Fuentes"}

WITHOUT = {
    "it": "E se i vicini fanno rumore?|È successo in via eccezionale <NUM> volte.|Il corso di inglese B2 dura <NUM> ore.|La piazza è chiusa, la strada anche, dopo le <TIME>.|Mia sorella può venire <NUM> notti?|Mia madre può entrare?|Wifi?|Parcheggio?|Suo fratello arriva lunedì.|NON_TROVATO|NON TROVATO|Purtroppo non posso dirlo.|Purtroppo, mi dispiace.|Buongiorno! Come si fa?|DOVE TROVO I GETTONI?|e le prese elettriche sono contate|Visite fino alle <TIME>.|Gli ospiti sono attesi, le stanze sono contate.|la ricevuta è la n. <RCPT>.|prot. <PROT>.|rif. <PROT>.|il codice dell'armadio è <LOCK>.|ho pagato <MONEY> € il <DATE>.|l'incontro è in Aula <SURNAME> alle <TIME>.|la sala <SURNAME> {resta chiusa|apre alle <TIME>}.|l'ho letto su @<WORD>_bot.|sul modulo c'è scritto nome.cognome@example.com come esempio.|è successo in via eccezionale <NUM> volte.|va bene via mail entro <NUM> giorni?|il corso di inglese B2 dura <NUM> ore.|in camera <NUM> manca la luce.|apre dal <NUM> al <NUM> aprile, dalle <TIME> alle <TIME>.|costa <MONEY> euro, pratica <PROT>.|pratica n. <RCPT>.|contattare [NAME], tel. [PHONE].|buongiorno! quando apre la Palestra?|Mi dispiace per l'attesa.|La Caparra viene resa entro <NUM> giorni.|chi arriva dopo le <TIME> ritira la chiave dal custode.|armadietto numero <NUM> in corridoio <NUM>.|Viola è il colore della porta.|l'alba e la luna piena.|Secondo l'ultima delibera, i residenti devono pagare.|i turni cambiano ogni Venerdì.",
    "en": "at the end of {January|February|March|June|October}, at no cost.|from <NUM> {February|May|December} to <NUM> {January|February|August}, with a fee.|{Monday|Tuesday|Sunday} to {Friday|Saturday} between <TIME> and <TIME>.|Wifi?|Parking?|My sister can come.|Final-year students may book before Friday.|Visits are allowed until <TIME> and the guest signs in.|Hello, when is it?|Unfortunately, nobody knows.|Bicycles go in the store.|Instruments are played at <TIME>.|the receipt is no. <RCPT>.|ref. <PROT>.|the locker code is <LOCK>.|i paid <MONEY> euro on <DATE>.|the meeting is in Aula <SURNAME> at <TIME>.|room <SURNAME> is closed.|i read it on @<WORD>_bot.|the form says nome.cognome@example.com as a sample.|is it fine via mail within <NUM> days?|May is a busy month, will room <NUM> be free?|the English course B2 lasts <NUM> hours.|Hi there, how much is it?|it opens from <NUM> to <NUM> April between <TIME> and <TIME>.|write to [EMAIL] or [PHONE].|Sorry for the wait.|Quiet hours begin at <TIME>.|file no. <RCPT>.|locker number <NUM> at the end of corridor <NUM>.|Please reply in Italian.|The Welcome Office opens on Monday.|Could you answer in French?|in the Exam Week, Workshop Coordinators must sign.",
    "de": "Hallo, darf man kochen?|Guten Tag, wann öffnet es?|Leider gilt das nicht.|Besuch ist bis <TIME> Uhr erlaubt.|die Quittung hat die Nr. <RCPT>.|Az. <PROT>.|der Code des Schranks ist <LOCK>.|das Treffen ist um <TIME> Uhr in der Aula <SURNAME>.|ich habe <MONEY> Euro am <DATE> gezahlt.|Im Formular steht nome.cognome@example.com als Muster.|In der Regel müssen die Gäste das Formular am Schalter abgeben.|Wie hoch ist die Kaution für Zimmer <NUM>?|Die Münzwäscherei öffnet am Montag um <TIME> Uhr.|Ab dem <NUM>. Mai dürfen Familien das Schließfach Nummer <NUM> im Büro buchen.|Es tut mir leid für die Wartezeit.|Aus Sicherheitsgründen sollen die Küchenpaten den Putzplan unterschreiben.|geht es per Mail in <NUM> Tagen?|Die Kaution von <MONEY> Euro wird erstattet.|Der Kurs Deutsch B2 dauert <NUM> Stunden.",
    "fr": "Vous demandez : quand ?|Vous avez demandé cela.|Bonjour, qui nettoie ?|Malheureusement, rien.|Les visites sont permises.|le reçu porte le n° <RCPT>.|réf. <PROT>.|le code du casier est <LOCK>.|la réunion est dans l'Aula <SURNAME> à <TIME>.|j'ai payé <MONEY> euros le <DATE>.|Quel est le montant de la caution pour la chambre <NUM> ?|La salle de musique ouvre le Mardi à <TIME>.|Désolé pour l'attente.|par mail sous <NUM> jours ?|Les Résidents doivent signer le casier numéro <NUM>.|le formulaire montre nome.cognome@example.com comme exemple.|À partir du <NUM> avril, les hôtes peuvent retirer la clé.|Peut-on {entrer|manger|dormir} après <TIME> ?|Où peut-on trouver la laverie ?|Doit-on signer le formulaire ?|{Ma sœur|Ma mère|Mon frère|Mon ami} {peut|doit}-{elle|il} venir <NUM> jours ?|Mon père arrive lundi.|Le silence dure jusqu'au lendemain matin.",
    "es": "Hola: ¿quién limpia?|Por desgracia, nada.|Las visitas se admiten.|el recibo es el n.º <RCPT>.|ref. <PROT>.|el código del armario es <LOCK>.|la reunión es en el Aula <SURNAME> a las <TIME>.|pagué <MONEY> euros el <DATE>.|¿De cuánto es la fianza de la habitación <NUM>?|Lo siento por la espera.|Hola: ¿cuándo abre la Biblioteca?|¿vale por mail en <NUM> días?|Los Residentes deben firmar la taquilla número <NUM>.|el formulario dice nome.cognome@example.com como muestra.|A partir del <NUM> de mayo, los huéspedes pueden entrar.",
}

#: Plain sentences in which a name said before comes again, and ordinary words that stand there too.
AGAIN = {
    "it": "Il pacco per {} resta in portineria.|Anche {} paga la caparra.|Domani {} passa a ritirare.|E per {} basta la firma.|Poi la chiave va a {}.|La stanza di {} resta chiusa.",
    "en": "The parcel for {} stays at the lodge.|Also {} pays the deposit.|Tomorrow {} comes to collect it.|And for {} a signature is enough.|Then the key goes to {}.|The room of {} stays closed.",
    "de": "Das Paket für {} bleibt an der Pforte.|Auch {} zahlt die Kaution.|Morgen holt {} alles ab.|Für {} genügt die Unterschrift.|Dann geht der Schlüssel an {}.",
    "fr": "Le colis pour {} reste à la loge.|Aussi {} paie la caution.|Demain {} vient le chercher.|Pour {} la signature suffit.|Puis la clé va à {}.",
    "es": "El paquete para {} queda en la portería.|También {} paga la fianza.|Mañana {} pasa a recogerlo.|Para {} basta la firma.|Luego la llave va a {}.",
}
PLAIN = {
    "it": "Segreteria Biblioteca Direzione chiunque Erasmus studenti Palestra residenti",
    "en": "Reception Library everybody Erasmus students Management visitors residents",
    "de": "Verwaltung Bibliothek jeder Erasmus Studierende Rezeption Gäste",
    "fr": "Direction Bibliothèque chacun Erasmus étudiants Accueil visiteurs",
    "es": "Dirección Biblioteca cualquiera Erasmus estudiantes Recepción visitantes",
}
