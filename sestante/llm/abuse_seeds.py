"""Labelled seed sentences for the abuse classifier, invented here.

``{a|b}`` stands for any one alternative; ``<G>`` for a group of people of the language. Positives insult, threaten,
degrade people for what they are or are sexually explicit; negatives are sober, neutral or harmless look-alikes.
"""

from __future__ import annotations

GROUPS = {
    "it": "gli stranieri|gli immigrati|le donne|i gay|i disabili|i credenti di altre fedi|i musulmani|gli ebrei|i rom|gli africani|gli anziani|i ragazzi del sud|le straniere|i profughi",
    "en": "foreigners|immigrants|women|gay people|disabled people|believers of other faiths|muslims|jews|black people|refugees|old people|folks from the south|trans people|asians",
    "de": "Ausländer|Einwanderer|Frauen|Schwule|Behinderte|Andersgläubige|Muslime|Juden|Schwarze|Flüchtlinge|alte Leute|Zugezogene",
    "fr": "les étrangers|les immigrés|les femmes|les homos|les handicapés|les croyants d'ailleurs|les musulmans|les juifs|les noirs|les réfugiés|les vieux|les gens du sud",
    "es": "los extranjeros|los inmigrantes|las mujeres|los gays|los discapacitados|los creyentes de fuera|los musulmanes|los judíos|los negros|los refugiados|los viejos|la gente del sur",
}

_BODY = {
    "it": "la faccia|i denti|il naso|le dita|le ossa|la lingua|le gambe|la testa",
    "en": "face|teeth|nose|fingers|bones|tongue|jaw|legs|skull",
    "de": "das Gesicht|die Zähne|die Nase|die Finger|die Knochen|die Zunge|die Beine",
    "fr": "la gueule|les dents|le nez|les doigts|les os|la langue|les jambes",
    "es": "la cara|los dientes|la nariz|los dedos|los huesos|la lengua|las piernas",
}

_INSULT = {
    "it": "idiota|cretino|imbecille|coglione|stronzo|bastardo|verme|deficiente|scemo|pezzo di merda|testa di cazzo|puttana|troia|zoccola|schifoso|fallito|parassita|minorato",
    "en": "idiot|cretin|moron|dickhead|bastard|scumbag|retard|asshole|bitch|slut|piece of shit|loser|whore|wanker|imbecile|worm",
    "de": "Idiot|Vollpfosten|Arschloch|Wichser|Schwachkopf|Drecksau|Hurensohn|Schlampe|Hure|Trottel|Missgeburt|Dreckskerl|Depp",
    "fr": "connard|abruti|crétin|salaud|enculé|imbécile|salope|pute|ordure|débile|fils de pute|idiot|minable",
    "es": "idiota|gilipollas|cabrón|imbécil|hijo de puta|zorra|puta|subnormal|capullo|cretino|mierda|inútil|guarra",
}

POSITIVE = {
    "it": [
        f"{{ma quanto|certo che}} sei {{{_INSULT['it']}}}",
        f"{{{_INSULT['it']}}} {{che non sei altro|di merda|maledetto|schifoso}}",
        f"{{brutto|lurido|sporco|povero}} {{{_INSULT['it']}}}",
        "{vaffanculo|vai a cagare|crepa|fottiti|muori}",
        f"{{giuro che ti|adesso ti|domani ti|vengo lì e ti}} {{spezzo|spacco|rompo|taglio|strappo}} {{di botto|tutta|tutte}} {{{_BODY['it']}}}",
        "{ti|vi} {ammazzo|uccido|accoltello|sgozzo|massacro|pesto a sangue|prendo a pugni|faccio a pezzi}",
        "{occhio|attento} che {ti aspetto fuori|ti vengo a cercare|finisci all'ospedale|ti meno}",
        "{ucciditi|ammazzati|sparisci} {verme|che schifo}",
        "{odio|mi fanno schifo|a morte|mandate via} <G>",
        "<G> {sono feccia umana|non sono umani|fanno vomitare|sono bestie|sono parassiti|sono topi|puzzano|non meritano di vivere|vanno presi a calci|vanno chiusi in gabbia}",
        "{quella razza|certa gente} è {inferiore|marcia|feccia|sporca di natura}",
        "{scopami|scopiamo|ti scopo|ti fotto|mi masturbo|succhiami|leccami} {tutta la notte|forte|adesso|ancora}",
        "{che belle tette|culo nudo|cazzo duro|figa bagnata|pompino gratis|orgasmo urlato}",
        "{spogliati|nuda|mutande giù} {e vieni qui|che ti scopo|sul letto}",
    ],
    "en": [
        f"{{what a|such a|bloody|you utter|you stupid}} {{{_INSULT['en']}}}",
        f"{{fuck you|screw you|go to hell|drop dead}} {{{_INSULT['en']}}}",
        f"{{i swear to|one day i'll|we shall|i'm going to}} {{smash|break|cut|rip off|crush}} {{your|his}} {{{_BODY['en']}}}",
        "{i'll|we will} {kill|murder|stab|strangle|beat up|hurt|burn} {you|him|them}",
        "{watch your back|you are dead|start running|you'll bleed}",
        "{kill yourself|go die|vanish} {worm|you disgust me}",
        "{i hate|death to|deport|get rid of} <G>",
        "<G> {are human garbage|are subhuman|make me sick|are beasts|are parasites|are vermin|stink|do not deserve to live|should be caged|need a beating}",
        "{that race|their kind} is {inferior|rotten|scum|dirty by blood}",
        "{fuck me|let's fuck|i'd fuck you|suck me|lick me|i masturbate} {hard|all night|right now|again}",
        "{huge tits|naked ass|hard cock|wet pussy|free blowjob|loud orgasm}",
        "{strip|naked|panties off} {and come here|so i can fuck you|on the bed}",
    ],
    "de": [
        f"{{so ein|was für ein|verdammter|blöder|du dreckiger}} {{{_INSULT['de']}}}",
        "{fick dich|verpiss dich|leck mich am arsch|krepier}",
        f"{{ich schwöre ich|morgen wird|gleich}} {{zerschlage|breche|zertrümmere|zerschneide}} {{man dir|dir bald|dir}} {{{_BODY['de']}}}",
        "{ich|wir} {töte|töten|ersteche|verprügeln|erwürge|schlagen} {dich|euch|ihn} {tot|blutig|endlich}",
        "{pass bloß auf|du bist tot|du wirst bluten}",
        "{bring dich um|stirb|hau ab} {du wurm|du ekelst mich an}",
        "{ich hasse|tod für|weg mit} <G>",
        "<G> {sind menschlicher abschaum|sind untermenschen|sind zum kotzen|sind viecher|sind parasiten|sind ungeziefer|stinken|verdienen kein leben|gehören in käfige|gehören verprügelt}",
        "{fick mich|ich ficke dich|lutsch mich|leck mich|ich wichse} {hart|die ganze nacht|sofort}",
        "{geile titten|nackter arsch|harter schwanz|feuchte muschi|lauter orgasmus}",
        "{zieh dich aus|nackt|höschen runter} {und komm her|damit ich dich ficke|aufs bett}",
    ],
    "fr": [
        f"{{quel|espèce d'|putain de|gros|sale}} {{{_INSULT['fr']}}}",
        "{va te faire foutre|nique ta mère|crève|va chier}",
        f"{{je jure que je vais te|demain je vais te|un jour on va te}} {{casser|casse|briser|arracher|arrache|couper}} {{{_BODY['fr']}}}",
        "{je vais|on va} {te tuer|te poignarder|t'égorger|te tabasser|te brûler|t'étrangler}",
        "{fais gaffe à toi|t'es mort|tu vas saigner}",
        "{suicide-toi|meurs|dégage} {ver de terre|tu me dégoûtes}",
        "{je hais|mort aux|virez} <G>",
        "<G> {ne sont que des déchets|sont moins qu'humains|me donnent envie de vomir|sont des bêtes|sont des parasites|vermine que tout ça|puent|ne méritent pas de vivre|en cage|qu'on les frappe}",
        "{baise-moi|je te baise|suce-moi|lèche-moi|je me masturbe} {fort|toute la nuit|tout de suite}",
        "{gros seins nus|cul nu|bite dure|chatte mouillée|orgasme bruyant}",
        "{déshabille-toi|nue|enlève ta culotte} {et viens ici|que je te baise|sur le lit}",
    ],
    "es": [
        f"{{qué|menudo|maldito|puto|asqueroso}} {{{_INSULT['es']}}}",
        "{vete a la mierda|que te jodan|muérete|jódete}",
        f"{{juro que te|mañana te|un día te}} {{rompo|parto|corto|arranco|reviento}} {{ambos|toda|todos}} {{{_BODY['es']}}}",
        "{te voy a|os vamos a} {matar|apuñalar|degollar|dar una paliza|quemar|estrangular}",
        "{ten cuidado conmigo|estás muerto|vas a sangrar}",
        "{suicídate|muere|lárgate} {gusano|me das asco}",
        "{odio a|muerte a|echad a} <G>",
        "<G> {son basura humana|son infrahumanos|dan ganas de vomitar|son bestias|son parásitos|son ratas|apestan|no merecen vivir|a la jaula|merecen una paliza}",
        "{fóllame|te follo|chúpame|lámeme|me masturbo} {duro|toda la noche|ya mismo}",
        "{tetas enormes|culo desnudo|polla dura|coño mojado|orgasmo a gritos}",
        "{desnúdate|desnuda|bragas fuera} {y ven aquí|que te follo|sobre la cama}",
    ],
}

NEGATIVE = {
    "it": [
        "<G> {festeggiano domenica|studiano qui vicino|cercano casa|hanno vinto il torneo|cantano nel coro|leggono molto|aprono un negozio}",
        "{abbiamo invitato|tutelare|aiutare|ospitare} <G> {a pranzo|è un dovere|con piacere}",
        "{vietato discriminare|no all'odio contro|un convegno su} <G>",
        "{segnalare|punire|prevenire} {insulti|minacce|molestie|violenze} {in ufficio|a scuola|sul lavoro}",
        "{educazione|salute|malattie} {sessuale|sessuali} {a scuola|per giovani|in farmacia}",
        "{che idiota sono stato|mi sento stupido|ammazzare il tempo|morire dal ridere|un verme nella mela|il cane bastardino dorme}",
        "{il seno dell'angolo|il culo della bottiglia|il gallo nel pollaio|la troia di maiali nella stalla}",
        "{referto|visita|esame} del {seno|pene|sangue} {in ospedale|dal medico}",
    ],
    "en": [
        "<G> {celebrate on sunday|study nearby|look for a flat|won the cup|sing in a choir|read a lot|open a shop}",
        "{we invited|protect|help|host} <G> {for lunch|is a duty|gladly}",
        "{never discriminate against|no hatred towards|a lecture about} <G>",
        "{report|punish|prevent} {insults|threats|harassment|violence} {in class|at school|at work}",
        "{sex education|sexual health|sexual diseases} {at school|for the young|in a pharmacy}",
        "{how stupid of me|i felt like an idiot|killing time|dying of laughter|a worm in an apple|a mongrel dog sleeps}",
        "{chicken breast|a cock crows|the ass carried hay|a bitch with her puppies}",
        "{report|scan|test} of the {breast|penis|blood} {in hospital|at a doctor}",
    ],
    "de": [
        "<G> {feiern am sonntag|lernen nebenan|suchen eine wohnung|gewannen den pokal|singen im chor|lesen viel}",
        "{wir haben|schützt|helft} <G> {eingeladen|gern|wie allen}",
        "{keine hetze gegen|ein vortrag über|niemals benachteiligt man} <G>",
        "{beleidigung|drohung|belästigung|gewalt} {im büro|in schulen|bei der arbeit} {melden|verhindern}",
        "{sexualkunde|sexuelle gesundheit|geschlechtskrankheiten} {in schulen|für jugendliche}",
        "{wie dumm von mir|ich idiot habe verschlafen|zeit totschlagen|tot gelacht|ein wurm im apfel}",
        "{hühnerbrust|der hahn kräht|ein esel trug heu}",
    ],
    "fr": [
        "<G> {font la fête dimanche|étudient à côté|cherchent un logement|ont gagné la coupe|chantent en chœur|lisent beaucoup}",
        "{on a invité|protéger|aider|accueillir} <G> {à midi|est un devoir|volontiers}",
        "{ne jamais discriminer|non à la haine contre|un exposé sur} <G>",
        "{signaler|punir|prévenir} {insultes|menaces|harcèlement|violences} {en classe|à l'école|au travail}",
        "{éducation|santé|maladies} {sexuelle|sexuelles} {à l'école|des jeunes}",
        "{que je suis bête|quel idiot j'ai été|tuer le temps|mourir de rire|un ver dans une pomme}",
        "{blanc de poulet|un coq chante|examen du sein chez un médecin}",
    ],
    "es": [
        "<G> {celebran el domingo|estudian cerca|buscan piso|ganaron la copa|cantan en un coro|leen mucho}",
        "{invitamos a|proteger a|ayudar a|acoger a} <G> {a comer|es un deber|con gusto}",
        "{nunca discriminar a|no al odio contra|una ponencia sobre} <G>",
        "{denunciar|castigar|prevenir} {insultos|amenazas|acoso|violencia} {en clase|en la escuela|en el trabajo}",
        "{educación|salud|enfermedades} {sexual|sexuales} {en la escuela|para jóvenes}",
        "{qué tonto fui|me sentí idiota|matar el tiempo|morir de risa|un gusano en una manzana}",
        "{pechuga de pollo|un gallo canta|examen de mama en un hospital}",
    ],
}
