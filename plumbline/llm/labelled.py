"""The small labelled table from which the tagger of personal information learns.

Each line is a form of sentence: brackets hold alternatives, marks in braces are its labelled pieces (NAME, EMAIL, PHONE,
ID_NUMBER, ADDRESS) or unlabelled fillers (vessel, town, number and the like). Lines that begin with a dash have no
personal information. Values for the marks are made up by the rules below, all fictitious. ``HELD_OUT`` has forms of its
own that no training text uses; they measure how the tagger does on sentences it was not shown.
"""

from __future__ import annotations

import random
import re

SENTENCES = r"""
(Kindly|Could you|Would you) (ring|phone|telephone|call) {NAME} (on|under) {PHONE} (tonight|before noon|as soon as she berths).
(Kindly|Do) (reach out to|get hold of|contact|reach) {NAME}, {EMAIL}, (before|once) the pilot (boards|is ordered).
(For questions|For anything urgent|After hours) (please reach|contact|ask for) {NAME} (at|on|via) {EMAIL} (or else|and|or) {PHONE} (day and night|at any hour|during the stay).
(Reach|Try|Text) {NAME} (at|by mail) {EMAIL} (first|if the line is dead).
You (may|can|should) (also|always) (call|reach|text) {NAME} (under|on|at) {PHONE}(| for the gate code| for a launch| about the visas).
The (gate|launch|visa) is arranged by {NAME} ({PHONE}), who (speaks|knows) the guards.
(The|Our) (boarding agent|superintendent|port captain|surveyor|waterclerk), {NAME}, (answers|can be reached|is available) (on|under|at) {PHONE}.
(The|Our) (superintendent|waterclerk|crew manager) {NAME} has a new (number|mobile|phone), {PHONE}.
(Mobile|Cell|Phone|Tel|Tel.|Telephone|Fax|Direct line|Office)(:| ) {PHONE}
(Mobile|Phone|Tel.) of the (agent|watchman|pilot station) is {PHONE}, (mail|e-mail|address) {EMAIL}, (ask|answer) any time.
(Agents|The agent's|Agent's) (new mobile|night number|phone) {PHONE} or (mail|e-mail) {EMAIL}
(E-mail|Mail|Email|Mailbox)(:| ) {EMAIL}
(Send|Forward|Mail) (the invoice|the statement|your sheets|the vouchers|a copy) to {EMAIL} (today|and keep the originals|without delay).
(Invoices|Copies|Vouchers|All copies|Invoice copies) (go|should be sent|are due) to {EMAIL} (only|before month end|please).
(Copies of the|The) (statement|invoice|voucher|log extract) (was|were) sent to {EMAIL} (yesterday|on {date}).
Anyone who saw it should write to {EMAIL} or (ring|dial) {PHONE}.
(Crew change|The crew change|Visa matters|Medical help): (contact|call|ask|dial) {PHONE}
(Contact|Number|Hotline) for (the crew|crew matters|the sick seaman): {PHONE}
In (an emergency|case of fire) (contact|call|inform) {NAME}, (phone|mobile|telephone|tel) {PHONE}.
Emergency (number|contact) of the (cook|bosun|cadet) is (his wife|his brother|the widow) {NAME}, {PHONE}.
(His|Her) (emergency contact|next of kin|wife|brother|father) is {NAME} (of|at|in) {ADDRESS}, phone {PHONE}.
(The next of kin|His next of kin|The widow|Her family|The cadet's mother) (lives|live|resides|stays) at {ADDRESS} (now|in {town}|near the church).
Next of kin: {NAME}, {ADDRESS}
(Home address|Address|Private address|Residence)(:| ) {ADDRESS}
(His|Her|The) home address (is|reads) {ADDRESS}, tel {PHONE}, (no mail|as told by the office).
He (gave|wrote|left) {ADDRESS} as (his|the) (home address|residence|address).
{NAME}, {ADDRESS}, {town}
(Deliver|Ship|Dispatch) the (pump|spare parts|parcel|charts|samples) to {ADDRESS}, {town}, (c/o|for|to the attention of|attention|attn) {NAME}(| please).
(The parcel|A box of spare parts|The charts) (for|marked) {NAME} (went|goes|was sent) to {ADDRESS} (in|near) {town}.
The agency (moved|has moved) to {ADDRESS}(| this month|, second floor).
{NAME} (signed on|signed off|embarked|joined|boarded|left) (yesterday|this morning|in {town}|at {town}|late) (with|holding|showing) (passport|a passport|travel document) (no. |number |){ID_NUMBER}(.| and a valid visa.)
(Joiner|Off-signer|On-signer|Signing on|Signing off): {NAME}, passport {ID_NUMBER}(|, visa in order)
{NAME} (carries|holds|showed|lost) (passport|seaman's book|seaman book|discharge book|identity card) {ID_NUMBER}(| since {year}).
(Passport|The passport|Seaman's book|The seaman's book|Discharge book|Identity card) {ID_NUMBER} (belongs to|was issued to|is held by|of) {NAME}(| was stamped| runs out in {year}).
(Passport|Seaman's book|Seaman book|ID card) (no.|number|nr.|) {ID_NUMBER} (is missing|expired|was found|was handed in|was left in the safe|is still on board|was not accepted).
The (passport|seaman's book|ID card) of {NAME}, {ID_NUMBER}, (has expired|was left ashore|stays with the agency|is on board).
(Tax number|Tax id|Tax no.|Social security no.|SSN|National id|National identity number|Personal number)(:| ) {ID_NUMBER}
(Tax number|Tax no.|Tax id) of {NAME} is {ID_NUMBER}.
(Payroll|Wages) of {NAME}, (tax no.|tax number|social security number) {ID_NUMBER}, (are|were) settled.
{NAME} (national id|tax no.|social security) {ID_NUMBER}
(National id|Tax no.) {ID_NUMBER} (with|and|,) address {ADDRESS} (and|,) phone {PHONE}
{NAME}\n{PHONE}
{NAME}\n{EMAIL}
(Kind regards|With kind regards|Best wishes|Many thanks|Sincerely|Yours truly|Cheers|Regards|B.rgds|Brgds|rgds|Rgds|Best regards),\n{NAME}
(Kind regards|Thanks and regards|Best rgds|rgds|Regards|Best regards),\n{NAME}\n{PHONE}
(With regards|Thanks|Best rgds|Rgds|Regards|regards),\n{NAME}\n{EMAIL}\n{PHONE}
(kind rgds|Best|thanks|rgds|Rgds),\n{NAME}\n{PHONE}\n{EMAIL}
Sent by {NAME}
From {NAME} to all (agents|stations|masters):
Dear {NAME}, (thank you|thanks) for the (call|stowage plan|offer).
Good day {NAME}, (the ship|cargo) is ready.
{rank} {NAME} (took|took over|resumed) command (in|off|at) {town}.
{rank} {NAME} (handed the|gave the|passed the) (watch|bridge|command) to the {job}.
{rank} {NAME} (handed|turned|gave) over to the (new|relieving) {job} (at noon|in {town}).
{rank} {NAME} and {rank} {NAME} (met|exchanged notes|changed places) in {town}.
{rank} {NAME} was relieved by {rank} {NAME} (on {date}|after lunch|in {town}).
{rank} {NAME} (reports|says|asks|confirms|protests) that the (hatch|crane|ladder) was (dry|safe|broken).
The {job}, {NAME}, (slipped|fell|was hurt|complained|was asked) (on deck|in the mess room|near hatch {n1}).
The {job} {NAME} (noticed|saw|reported|heard) (smoke|a leak|the alarm).
(A statement|The statement|Testimony) (by|of|from) {NAME} (was|is) (taken|recorded|attached)(| on the bridge| in the mess|in {town}).
(We took|They took|The police took) a statement from {NAME} (on|in) {date}.
(I|We) (met|saw|spoke to|spoke with|talked with|heard from|listened to) {NAME} (about|on|over) the (tank|survey|claim|wages|damage).
(I|We) (discussed|settled) the (wash|survey|claim) with {NAME} (on the bridge|ashore|by phone).
(According to|As told by|In the words of) {NAME}, the (seal|hatch|valve) was (intact|broken|open)(|; dial {PHONE} to verify).
(Witness|Witnessed by|Attended by|Signed by|Signed for by|Reported by|Prepared by|Checked by)(:| ) {NAME}
(The protest|The report|The survey|This form) (was|has been) (signed|drawn up|countersigned|checked) by {NAME} (in|at|of) {town}.
The (surveyor|inspector|doctor|chandler|consul) {NAME} (attended|came on board|declined|signed the sheet).
(Mr|Mrs|Ms|Dr|Capt.|Captain) {NAME} (will|shall) (attend|inspect|meet) the (vessel|crew) in {town}.
{NAME} (is|was) (on leave|ashore|in hospital|on watch|sick|our contact|the new waterclerk).
{NAME} (is|can be) (reached|found|contacted) (on|at|under) {PHONE} (till late|only by day|from {clock}).
{NAME} (called|rang|wrote|replied|asked) (from|on) {PHONE} (twice|at {clock}).
{NAME} (wrote|replied) from {EMAIL} (yesterday|at {clock}).
Bitte (rufen Sie|kontaktieren Sie) {NAME} (unter|auf) {PHONE} (an|zurück).
(Bitte|Gern|Dann) {NAME} (mobil|direkt|nachts) unter {PHONE} (anrufen|erreichen|verständigen)(.| und fragen.)
(Ansprechpartner|Kontakt|Sachbearbeiterin) (ist|:) {NAME}, {PHONE}
(Der Reisepass|Reisepass|Der Pass|Das Seefahrtsbuch|Seefahrtsbuch|Der Ausweis) (Nr. |){ID_NUMBER} (von|gehört) {NAME}( laut Liste| ist abgelaufen| liegt beim Agenten| war nicht dabei| fehlt noch immer).
(Reisepass|Seefahrtsbuch|Personalausweis) (Nr. |){ID_NUMBER} (wurde|ist) (gefunden|abgegeben|heute vorgelegt|verloren).
(Die Steuernummer|Steuer-ID|Steuernummer) (von {NAME} |)(lautet|ist) {ID_NUMBER}.
(Fragen|Alle Fragen|Meldungen|Rückfragen bitte) (an|bitte an) {EMAIL}(.| senden., |, gezeichnet {NAME}|, Grüße {NAME})
(Mit freundlichen Grüßen|Viele Grüße|gez.|Gruß)(\n| ){NAME}
(Die Post|Das Paket|Die Ersatzteile|Post) (geht|gehen|bitte) an {ADDRESS}(, {town}| in {town}).
(Er|Sie|Die Familie) wohnt (in der |){ADDRESS}, {town}.
(Kapitän|Lotse|Herr|Frau) {NAME} (übernahm|meldet|bestätigt|kam) (die Wache|in {town}|den Schaden).
(Por favor|Favor de) (llame|llamar|avise) a {NAME} (al|en el) {PHONE} (mañana|hoy).
Llame (hoy|mañana|luego) a {NAME} (al|en el) {PHONE}(.| sin falta.)
El (pasaporte|libro|documento) {ID_NUMBER} (de|pertenece a) {NAME}(| está caducado| falta| venció).
(Pasaporte|Libreta|DNI) (n.º |nro. |){ID_NUMBER} (perdido|entregado|caducado ayer|de {NAME} en la agencia).
(Consultas y copias|Las facturas|Facturas|Preguntas) (a|al correo) {EMAIL}(.|, atentamente {NAME}|, firma {NAME}|, firmado por {NAME})
(El paquete|Los repuestos|Enviar todo|Enviar la carta) (va |)a {ADDRESS}(, {town}| en {town}).
(Saludos|Atentamente|Firmado),\n{NAME}
(El capitán|La inspectora|El práctico) {NAME} (subió|firmó|llegó) en {town}.
(Veuillez|Merci de) (appeler|joindre|contacter) {NAME} (au|sur) {PHONE} (demain|ce soir).
(Appelez|Joignez) (donc|vite|d'abord) {NAME} au {PHONE}(.| avant midi.)
(Le passeport|Passeport|Le livret) (n° |){ID_NUMBER} (de|appartient à) {NAME}( d'après lui| est périmé| a été retrouvé| manque).
(Passeport|Livret) (n° |){ID_NUMBER} (perdu|remis à l'agent|périmé hier|de {NAME} à l'agence).
(Les factures|Factures|Toute question|Questions et copies) à {EMAIL}(.|, cordialement {NAME}|, signature {NAME}|, signé par {NAME})
(Le colis|Les pièces|Le courrier|Courrier) (est|sont|à envoyer|va) (pour|à) {ADDRESS}(, {town}| à {town}).
(Cordialement|Salutations|Signé),\n{NAME}
(Le capitaine|L'inspectrice|Le pilote) {NAME} (est monté|a signé|arrive) à {town}.
Appelez {NAME} (ce soir|vite|chez lui) au {PHONE}, (il|elle) attend.
(Appelez|Prévenez|Demandez) {NAME} (au plus tard|avant minuit).
According to {NAME} (nobody|the cook|no one) (saw|heard) (it|anything).
According to {NAME} this (happened|began) at {clock}.
(Passport|Seaman's book|Tax number|ID) {ID_NUMBER} / {NAME} / {town}
{ID_NUMBER} / {NAME} / {job}
{NAME} / {ID_NUMBER} / {ADDRESS}
(Die Post|Ein Brief|Das Geschenk) an {ADDRESS}, {town}, kam zurück.
(Brief|Rechnung|Lieferung) an {ADDRESS}, {town}
(The mother|Her aunt|The family) lives at {ADDRESS}.
Attention {NAME}: (the|your) (boxes|charts) (are here|came).
- (A container|Container|Box|The reefer box|Reefer) {container} (of {vessel} |)(stands|leaked|was opened|was empty|is overweight|moved) (at|on|in|near) (berth {berth}|bay {n2}|the yard).
- (Containers|Boxes) {container} and {container} (are|were) (shut out|short landed|on hold).
- (Rendezvous|Convoy|Tow|Escort|Transfer|Lightering) (with|by|from|to|behind) {vessel} (at|from|on) ({clock}|{date}) (off|near) {town}.
- (A tow|Assistance|Fuel|Water|An escort) (was|is) (given|ordered|promised|booked) (with|by|from|to|for) {vessel} (at|from|for) {clock}.
- {vessel} (is|was) (heeding|ignoring|leaving|awaiting|passing|crossing|entering) (the|a) {thing} at {clock}.
- {vessel} (and|with|behind|ahead of) {vessel} (leave|left|enter) {town}.
- (TO|CC|FROM|FM|ATTN): (MASTER|ALL SHIPS|FLEET OFFICE|CREWING DESK|DUTY OFFICER|PORT CONTROL)\nRE {thing}
- (TO|CC|FM): (MASTER|FLEET DESK|NIGHT OFFICE)
- (Certificate|Policy|Order|Claim|Docket|File|Notice) (no.|number|nr.) {bl} (of|dated) {date}
(Tax number|SSN|Passport|Ausweis|DNI|Livret) {ID_NUMBER} (/|,|-|:) {NAME}
(i.A.|signature:|firma:|signé:|gezeichnet|for the owners) {NAME}
- (Distance|Speed|Course|Fresh|Yard|Hull|Deck|Cargo|Crew|Engine|Weather|Visibility|Swell|Fuel|Draft|Trim|Ballast|Water|Stores|Charts|Anchor|Cable|Radar|Compass|Ice|Fog|Rain|Night|Noon|Hire|Demurrage|Freight|Consumption|Bunkers|Holds|Hatches|Cranes|Tugs|Pilots|Light|Buoy|Channel|Position|Warning|Notice|Rest|Wages|Mail) (log|report|figures|check|sheet|list|run|remarks) (no. |of |){n3}
- (How|Which|What|When|Where|Why|Who|Whose) (many|of the|did|was|will) {adj} {thing} (near|of|by) {town}?
- (Certificate|Policy|Order|Claim|Seal) {n9} (was|is) (filed|void|paid|broken).
- {vessel} (dropped|let go) anchor (off|near) {town} at {clock}, position {position}.
- {vessel} (reached|made|left|cleared|passed) {town} (Roads|) (on {date}|at {clock}|yesterday) (and anchored|in ballast|fully laden|without tugs).
- {vessel} (altered|changed) course to {n3} at {clock} (because of|following|after) (the|a) {thing}.
- {vessel} and {vessel} (touched|collided|met) (at|near|off) berth {berth}, (the dent|damage) measures {n1} m.
- (The|An) inspection of {vessel}, {n5} GT, built in {year}, (took place|was held) (at|in) {town}.
- {vessel} (ist|liegt) (seit|um) {clock} (Uhr |)(vor|in|bei) {town}, Tiefgang (vorn |){dec} m.
- {vessel} (verließ|erreichte) {town} um {clock} Uhr mit {dec} m Tiefgang.
- El (buque|remolcador) {vessel} (zarpó|salió ayer) de {town} a las {clock} (con|y) calado (de |){dec}.
- (Le navire|Le remorqueur|Le vraquier) {vessel} (quitte|a quitté|touche) {town} à {clock}, tirant (d'eau |){dec}.
- L'arrivée (est prévue|était prévue) (le|pour le) {date}, mouillage (sur rade|en {position}).
- (At|About|Around) {clock} the {job} (heard|saw|noticed|felt) (a|the) {thing} (while|when) {vessel} (lay|was) (off|near) {town}(| Roads).
- (The {job}|Our {job}|Second mate) (plotted|posted|logged) (a|an) (position|lookout) because (fog|rain) cut the (visibility|range) to {n1} cables.
- Berth {berth} (will be|stays|remains) (taken|busy|free|closed) until {date}, (count on|expect) {n1} (hours|days) of waiting.
- Liegeplatz {berth} (bleibt|ist) (bis|ab) {date} (belegt|frei).
- (The|A) bunker barge {vessel} (gave|pumped|delivered) {dec} tons at {n1} cSt with {dec} percent sulphur.
- Call sign {callsign} (shows|is used|was heard) on two hulls (built|from) {year}.
- (Gangs|Stevedores) (worked|discharged|loaded) {dec} t of {cargo} with {n1} gangs (a|per) shift.
- (The|This) certificate ({thing}) (lapses|runs out|is valid until) {date}; owners (ask|want) {n1} more weeks.
- (The charterers|Owners|Brokers) (asked for|offer|counter) (a |)laycan (from |){date}/{date} at USD {money} (daily|a day|pdpr) less {n1} percent commission.
- (The daily|Daily) consumption (was|is) {n1} t of VLSFO plus {dec} t of MGO, (ROB|remaining) {dec} t.
- (A|The) container {container} (had|showed|came with) a (broken|missing|damaged) seal.
- (A deficiency|Deficiencies) ({n5}|code {n5}) (for|about|concerning) the {thing} (must|should) be (mended|cleared) (here|before sailing).
- (The demurrage|Demurrage) for {town} (is|was) {n1} days {n1} hours by our count.
- (Der Wind|Wind) (weht|drehte) (mit|auf) {n1} aus {wind}, Sicht (gut|mäßig|{n1} nm).
- Die (Prüfung|Besichtigung) (fand|zeigte) {n1} Mängel (am|an der) (Ruder|Winde|Kran).
- (Made good|Steamed|Run) {n3} miles, {n3} to go, arrival {town} {date} at {clock} local time.
- (The drafts|Drafts) (are|were) {dec} (forward|fore) and {dec} aft, (trim|list) as in {town}.
- Le déchargement (de |){cargo} ({dec} t) (continue|reprend) au quai {berth}.
- (La descarga|Descarga) de {dec} t de {cargo} (sigue|terminó) en el muelle {berth}.
- (El registro|La lista) (da|tiene|muestra) el IMO {n7} (bajo|con) el nombre {vessel}(| y también {vessel}).
- (The emergency|Our spare|Emergency) generator (failed|started) (twice|at once|at the second try).
- (Old|An old) log: in a {adj} (winter|summer) (at|near) {town} the {who} (drew|weighed|painted) the {adj} {thing}, {n3} fathoms (from|below) {town}.
- FM (AGENCY|MASTER|CHARTERING)\nSUBJECT {thing}
- (SUBJ|RE|Subject|Ref): {thing} (in|at) {town}
- (The fire|A fire) pump (gave|reached) {dec} bar (aft|forward).
- (The flag|Flag) of IMO {n7} (is|became|changed) (LR|PA|MT) after the name {vessel}.
- As the {who} (told|wrote), the {adj} {thing} of {town} (grew|sank|stood) {n3} paces (from|beside) the {adj} {thing}.
- (Pratique|Free pratique) (came|was given) at {clock}, gangway (rigged|lowered) at {clock}.
- (Fresh water|Water) {dec} t, made {dec} t (in a day|since noon).
- (The hire|Our hire|Hire) statement {bl} is short by USD {money}.
- (Holds|All holds|Tanks) (are clean|were washed|are ready) for {cargo}(| and {cargo}).
- (IMO {n7}|Die Nummer IMO {n7}) (steht|ist) (im|mit dem) Register (als|unter) {vessel}.
- The number IMO {n7} (on|at) the stern (differs|is wrong) (from|by) the lifeboat's.
- (Ice|Drift ice) (near|off) {town}; {vessel} (leads|escorts) us from {clock}.
- L'inspection (montre|a trouvé) {n1} défauts (sur|au) (guindeau|treuil).
- (La inspección|El inspector) (halló|vio) {n1} deficiencias (en|a) (cubierta|popa).
- (Die Ladung|Ladung) (besteht aus|sind) {dec} t {cargo}, Luke {n1} (ist|bleibt) zu.
- Le registre (porte|donne) (deux|trois) pavillons (au|pour) IMO {n7}.
- (The light|Buoy|Light) {berth} (near|off) {town} (is|was) (out|dark|unlit) since {date}.
- (Load|Loading|To load) {dec} t of {cargo} at {town} for {town} or {town}(| range).
- The MMSI {n9} (was given|belonged) to {vessel} (before|until) {date}.
- (The engine|Main engine) ran {n3} rpm with {dec} percent slip, (unit|cylinder) {n1} (too hot|smoking).
- (The broker|Brokers) still (print|list) {vessel} though (the name|she) is {vessel} now.
- (Luckily|Thankfully) nobody was (injured|hurt), the loss is USD {money}.
- (At noon|Noon) in {position}, steering {n3}, {dec} knots (over|in) {n1} hours.
- (The pilot|Pilot) (came|boarded) {n1} miles (off|from) the (breakwater|buoy), draft limit {dec} m.
- Owners (keep|leave) the offer (open|firm) until {clock}(| today).
- Q. Who (built|sold|kept) the {thing} of {town}? A. The {adj} {who}, {n2} (years|days) ago.
- (In this|Read this) passage the {who} of {town} (counts|owns|keeps) {n3} {adj} {thing} and a {adj} {thing}.
- (Records|Both records) (were joined|merged) after (a|the) review at {dec} percent, (home port|registry) {town}.
- (The rest|Rest) hours of the {job} (show|have) {n1} gaps (in|during) week {n1}.
- (The steering|Steering) (stopped|failed|jammed) in {position} for {n1} minutes.
- (Lines|Survey lines) {n1} to {n1} (were run|must be run) again, swell (over|above) {n1} m.
- (The bill|Bill of lading) {bl} (says|reads) {dec} t (against|but) {dec} t by draft.
- (We found|Crew found) water in hold {n1}, pumps {n1} and {n1} (run|are running).
- The (recorder|VDR) (says|gives|shows) {dec} knots {n1} minutes before (the|that) (contact|impact).
- (The register|Lloyd's list) gives {n5} GT, (class|the class) gives {n5} GT.
- The {who} (of|from|at) {town} (sketched|paced|counted) {n3} {adj} {thing} (by|under|near) the {adj} {thing} of {town}.
- (The transponder|A transponder) of MMSI {n9} (sent|gave) a (false|wrong) name for {n1} days.
- (The tugs|Tugs) {vessel} and {vessel} (pushed|assisted|stood by) (to|at) berth {berth}.
- (On channel|Channel) {n2} (port|harbour) control (replied|answered) after {n1} calls.
- (Le vent|Vent) de {wind} force {n1}, mer (belle|agitée|{n1}).
- (El viento|Viento) del {wind} fuerza {n1}, (mar|marejada) {n1}.
- (She|The ship) (can carry|is fitted for) {cargo}, {cargo} (or|and) {cargo}.
- (Navigational|Warning) {n5}: a {thing} (was seen|drifts) in {position}.
- (Open|Our) {vessel}, {town} {date}, {n5} dwt, {dec} knots (laden|ballast).
- Wind (was|is|from) {wind} at force {n1}, seas {n1}, swell {n1} m (from|out of) {wind}.
- (The yard|Our yard|Yard) (needs|wants) {n1} days for the {thing}, {n1} for {n5} square metres (of blasting|of paint).
- (Shippers are|Consignee is|Managers are|Sold to) {firm} (of|in) {town}.
- {firm} (pays|ordered|supplied|owes) {dec} t of {cargo} (by|on) {date}.
- (The|A) {thing} (near|between|off) {town} (and {town} |)(is|was) (closed|marked|gone).
- {town} (harbour|port|pilots|control) (closed|advised|replied) at {clock}.
- (Bound|Sailing) from {town} to {town} via {town}, {n3} miles.
- Monday Tuesday Friday: {thing}, {thing}, {cargo}.
- Ref {bl}, file {n5}-{n2}, order no. {n5}, page {n1} of {n2}
- (Port|Previous port|Next port|Last port): {town}
- Name: {vessel}, (ex|formerly) {vessel}, flag LR, class number {n7}
- El puerto de {town} (abre|cierra) a las {clock}; La Salida (es|fue) el {date}.
- Der Hafen {town} (öffnet|schließt) um {clock}; Die Abfahrt (ist|war) am {date}.
- Le Port de {town} (ouvre|ferme) à {clock}; Le Départ (est|était) le {date}.
"""

#: Forms for measuring only.
HELD_OUT = r"""
Ring me back on {PHONE}, it is about the fenders.
Could {NAME} bring the stores list when she comes aboard?
{NAME} will wait at the barrier with a sign.
The widow asked us to post everything to {ADDRESS}.
Her passport, {ID_NUMBER}, turned up in the ship's safe.
Visas were refused to {NAME} (passport {ID_NUMBER}) and one cadet.
My private mail is {EMAIL} in case the server is down.
The customs officer wrote down {ID_NUMBER} as tax number of {NAME}.
{rank} {NAME} blamed the tug for the scratch.
Last seen with {NAME} near the crew bus in {town}.
Anything else goes through {NAME} at the office, {PHONE}.
The doctor, {NAME}, examined two men and left at {clock}.
Please let {NAME} know that berth {berth} is free.
Sincerely yours\n{NAME}\n{EMAIL}
Contact person ashore: {NAME}, {EMAIL}
Flowers were sent to {ADDRESS}, {town}, for the family.
His social security card reads {ID_NUMBER}.
WhatsApp {PHONE} works best at night.
Der Koch {NAME} hat sein Seefahrtsbuch {ID_NUMBER} vergessen.
Frau {NAME} ist im Büro unter {PHONE} zu sprechen.
Unterlagen bitte nach {ADDRESS}, {town} schicken.
La doctora {NAME} atiende en el {PHONE}.
Su pasaporte, {ID_NUMBER}, quedó en la agencia.
Vive en {ADDRESS}, cerca del puerto.
Madame {NAME} répond au {PHONE} le matin.
Il habite {ADDRESS} avec sa famille.
Son passeport {ID_NUMBER} reste chez l'agent.
- {vessel} shifted to berth {berth} while {vessel} waited outside {town}.
- The stowage plan of {vessel} lists {dec} t of {cargo} for {town}.
- Salvors reached {vessel} at {clock}; no pollution was seen.
- Nothing to report from {town} this week.
- {firm} sold {vessel} for USD {money}.
- Speed fell to {dec} knots in heavy seas, course {n3}.
- Der Schlepper {vessel} kam {n1} Stunden zu spät.
- El remolcador {vessel} llegó a {town} con {n1} horas de retraso.
- Le cargo {vessel} attend devant {town} depuis {n1} jours.
"""

FIRST = "Maria Peter Elena John Aisha Björn Carla Dmitri Esra Felix Greta Henrik Irina João Klara Luis Magda Nils Olga Paolo Quentin Rosa Sven Tara Umar Vera Willem Xenia Yusuf Zita Renée Øyvind".split()
LAST = "Almqvist Barros Castellan Dombrow Egerton Falkner Grünwald Holloran Iversen Jablonka Kirchner Lombardi Mendoza Norling Orlandini Petrov Quiroga Rossiter Sørensen Tamura Ullmann Valdés Wexford Yamazaki Zelenka Marrow Steele Thornby Okonkwo Dufour Kowalczyk Nakagawa Belmondo Corrigan Drummond Fenimore Hallström Isherwood Jurado Keating".split()
TOWN_A = "Ald Bren Cor Dun Elm Fal Gren Hol Ing Jar Kel Lor Mar Nor Ost Pel Rav Sel Tor Ulm Ven Wes Yar Zan".split()
TOWN_B = "by dale fjord ford gate ham haven hold mer mouth ness port quay sund thorpe vik wick wyn".split()
SHIP = "STAR OCEAN PRIDE NORTHERN SPIRIT LADY PACIFIC DAWN EMERALD GLORY HORIZON PIONEER ATLANTIC QUEEN BREEZE FALCON".split()
MID = ["van der Holm", "de Vries", "O'Hara", "Lind-Berg", "von Arnim", "D'Acosta"]


def _town(r: random.Random) -> str:
    name = r.choice(TOWN_A) + r.choice(TOWN_A).lower() * r.randint(0, 1) + r.choice(TOWN_B)
    return name + r.choice(["", "", "", " Roads", " Bay", " Point", " Quay"])


def _digits(r: random.Random, form: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else r.choice("ABCDEFGHKLMNPQRSTUVWXYZ") if c == "A" else c for c in form)


def _name(r: random.Random) -> str:
    first, last = r.choice(FIRST), r.choice(LAST) if r.random() < 0.85 else r.choice(MID)
    form = r.random()
    if form < 0.35:
        return f"{first} {last}"
    if form < 0.5:
        return f"{last.upper()}, {first}"
    if form < 0.65:
        return f"{first} {last.upper()}"
    if form < 0.78:
        return f"{first[0]}. {last}"
    if form < 0.92:
        return f"{first} {r.choice('ABEHJKLMT')}. {last}"
    return f"{first} {last}"


def _email(r: random.Random) -> str:
    first, last = (r.choice(x).lower().encode("ascii", "ignore").decode() for x in (FIRST, LAST))
    dot = r.choice([".", ".", ".", "(dot)", " dot "])
    at = {"(dot)": [" (at) ", "[at]"], " dot ": [" AT "]}.get(dot, ["@", "@", "@", "@", " @ ", " (at) ", "[at]", " AT "])
    local = r.choice([f"{first}{dot}{last}", f"{first[0]}_{last}", f"{last}{r.randint(2, 99)}", f"{first}+ops"])
    domain = r.choice(["example.org", "mail.example.com", "fleet.test", "crew.example.org", "agency.example", "ships.invalid", "example.net"]).replace(".", dot)
    return local + r.choice(at) + domain


PHONES = "+99 9999 999999;+999999999999;09999 999999;+99 99 9999 9999;099 9999 9999;+99(0)9999999999;0099 99 9999 9999;(09) 9999 9999;+99 999 999 999;0999 999 999;(999) 999-9999;+9 999-999-9999;+9-999-999-9999;999.999.9999;+99 99 99999 999;+99 (0)99 99999999;+99 9 99 99 99 99;09 99 99 99 99;09.99.99.99.99;099 99999 999;099/9999999".split(";")
IDS = "AA-99999/99;AA9999999;AA 99 99 99 A;999-99-9999;9999 9999 9999 99;A99999999".split(";")


def _address(r: random.Random) -> str:
    number = str(r.randint(1, 240)) + r.choice(["", "", "", "a", "b", "A", "B", "-3", "-3"])
    place = r.choice(TOWN_A) + r.choice(TOWN_B + [x.lower() for x in TOWN_A])
    form = r.random()
    if form < 0.5:
        return ("Flat 2, " if r.random() < 0.35 else "") + f"{number} {place} {r.choice(['Street', 'Road', 'Lane', 'Ave.', 'Crescent'])}"
    if form < 0.67:
        return f"{place}{r.choice(['straße', 'weg', 'gasse'])} {number}"
    if form < 0.84:
        return f"{r.choice(['Calle', 'Avenida', 'C/'])} {place}, {number}"
    return f"{number}, {r.choice(['rue', 'avenue', 'quai'])} de {place}"


def _vessel(r: random.Random) -> str:
    title = r.choice(["", "", "MV ", "MT ", "M/V ", "tug "])
    form = r.random()
    if form < 0.4:
        return title + r.choice(SHIP) + " " + r.choice(SHIP)
    if form < 0.65:
        return title + r.choice(FIRST).upper() + " " + _town(r).split()[0].upper()
    if form < 0.85:
        return title + r.choice(SHIP) + " " + _town(r).split()[0].upper()
    return title + _town(r).split()[0].upper() + r.choice(["", f" {r.randint(2, 99)}"])


def _firm(r: random.Random) -> str:
    head = r.choice([r.choice(LAST), r.choice(SHIP).title(), f"{r.choice(SHIP).title()} {r.choice(SHIP).title()}", f"{r.choice(LAST)} & {r.choice(LAST)}"])
    return f"{head} {r.choice(['Shipping', 'Marine', 'Bulk Carriers', 'Agencies', 'Chartering', 'Towage', 'Ship Supply', 'Maritime'])} {r.choice(['Ltd', 'Ltd.', 'GmbH', 'SA', 'Inc', 'AS', 'BV'])}"


_WORDS = {
    "rank": ["Capt.", "Capt.", "Capt.", "Captain", "Master", "Mr"],
    "job": ["chief officer", "second engineer", "bosun", "third officer", "cook", "chief engineer"],
    "thing": ["traffic lane", "oil leak at the separator", "nav light dark", "fishing gear", "load line", "tide gauge", "keelson", "mooring", "lock gates", "shaft seal", "current", "expired flares", "copper sheathing", "slipway"],
    "cargo": ["wheat", "palm oil", "fertiliser", "coils", "gasoil", "clinker", "frozen fish", "logs"],
    "wind": ["N", "NE", "E", "SE", "S", "SW", "W", "NW"],
    "adj": ["hollow", "patient", "narrow", "crooked", "quiet", "stubborn", "amber", "weathered"],
    "who": ["retired hydrographer", "dredging crew", "tide committee", "relief keeper", "island pilot", "ferry purser"],
    "berth": ["A7", "B12", "C24", "D5", "E18", "K28"],
}
_FORMS = {
    "clock": ["99:99", "9999"], "n1": ["9"], "n2": ["99"], "n3": ["999", "99"], "n5": ["99999", "9999"], "n7": ["9999999"], "n9": ["999999999"], "dec": ["9.9", "99.9", "999.9", "9999.9"], "year": ["1999", "2099"], "bl": ["BL99999999"],
    "container": ["QXAA9999999"], "money": ["99,999", "999,999"], "callsign": ["AAA99", "9AA9", "AAAA9", "AA9A99"], "position": ["99-99.9S 099-99.9E", "99-99.9N 199-99.9W"], "date": ["9 Aug", "19-Sep", "29. Jan", "9 May", "2-Dec"],
}


def _value(mark: str, r: random.Random) -> str:
    if mark in _WORDS:
        return r.choice(_WORDS[mark])
    if mark in _FORMS:
        return _digits(r, r.choice(_FORMS[mark]))
    made = {"NAME": _name, "EMAIL": _email, "ADDRESS": _address, "vessel": _vessel, "town": _town, "firm": _firm}.get(mark)
    return made(r) if made else _digits(r, r.choice(PHONES if mark == "PHONE" else IDS))


def _opened(line: str, r: random.Random) -> str:
    """A form with one alternative of each bracket; brackets without a bar are text."""
    return re.sub(r"\(([^()|]*(?:\|[^()|]*)+)\)", lambda m: r.choice(m[1].split("|")), line)


#: Words before and after pieces, from which scraps of text are put together: a cue, a value and what follows.
SCRAPS = {
    "NAME": ("According to;Ask;ask;Call;call;Tell;Contact;contact;Attn;attn;Attention;attention;signed;gez.;von;an;mit;Herrn;Frau;Appelez;appelez;Contactez;selon;signé;pour;par;avec;Llame a;llame a;Avise a;firmado;según;con;para;de;by;with;from;to;met;saw;joined;relieved;taken from;heard from;obtained from;interviewed;asked by;and;Capt.;Capt.;Captain;Mr;Mrs;for;/;-;(;:;;that;when;Dear", " the; and; has; was; is; said; wrote; will; on; at; in; with; from; (;/;:;\n; au; al; unter; fehlt; a; est; hat; ist; ha;.;.;,;,;, who; about; signed; joined; left; over; for;;;;;; caducado; périmé; missing"),
    "ID_NUMBER": ("passport;Passport;Reisepass;Pasaporte;Passeport;passeport;pasaporte;Seefahrtsbuch;Tax no.;tax no.;tax number;Tax number;SSN;national id;National id;seaman's book;Seaman book;Seaman's book;discharge book;identity card;Ausweis;Personalausweis;passport no.;Passport No.;with passport;book;Steuernummer", ";.;,; /; / {NAME}; / {NAME};, {NAME}; of {NAME}; von {NAME}; de {NAME}; of; von; de; was; is; has; fehlt; est; está; wurde; and;\n; (;)"),
    "ADDRESS": ("at;to;an;a;pour;in;lives at;lived at;Post an;address;Address;home address;:;;an die;to the agency at;wohnt;vive en;habite", ", {town};.;, {town}.; and;\n; tel {PHONE};, phone {PHONE};, attention {NAME};, c/o {NAME}; (back door)"),
    "PHONE": ("on;at;under;tel;Tel.;phone;mobile;Mobile;call;dial;ring;text;unter;au;al;(;+;or;or;and;:;\n;no.", ";.;,;);\n; or {EMAIL};\n{EMAIL}; and; for; anrufen; after; / {EMAIL}"),
    "EMAIL": ("at;to;mail;e-mail;an;a;à;via;or;and;:;\n;write to;copies to;Copies to", ";.;,;\n; please; or {PHONE};\n{PHONE}; and; / {PHONE};, gez. {NAME};, firmado {NAME};, signé {NAME};, signed {NAME}"),
    "vessel": ("with;by;from;to;of;against;behind;for;and;near;escort;alongside;between;von;mit;de;con;avec;par;name;the;:;;;;arranged with;shared with;former name;formerly;unter dem Namen;con el nombre;sous le nom;als;bajo;le;el;der;off;past;than;(", " is; was; has; and; at; in; on; from; to; sent; arrived; left; built; after;.;,;:; hat; a; est; ha; following; alongside; off; with; (; still; attended;\n; between"),
    "town": ("at;in;near;off;from;to;of;for;via;in;nach;vor;von;en;de;à;pour;by;between;port of;and;or;agent in;ETA;open", " is; was; and; or; at; on; for; in;.;,; Roads; port; on {date}; {date}; {clock}; to; via;\n; then; were;, said the;, wrote the;, asked a;, as; , near"),
    "firm": ("by;from;with;to;for;of;Messrs;messrs;agents;owners;;;an;von;à;de;a;per;c/o", " is; was; and; have; pays; in; at;.;,;:;\n; as agents; on behalf"),
    "container": ("Container;container;Box;box;in;of;and;unit;Reefer;CNTR", " is; was; and; found; with;.;,;\n; on; seal; in; came"),
    "n7": ("IMO;imo;number;No.;Nr. IMO;der IMO;el IMO;le IMO;for IMO;of IMO", " is; was; and; on;.;,;:; ist; tiene; est"),
    "n9": ("MMSI;mmsi;of MMSI;seal;Seal", " is; was; and; sent;.;,;:"),
    "bl": ("bill;B/L;bill of lading;statement;number;ref;Ref.;invoice;voyage", " is; was; shows; and;.;,;:; of {date}"),
    "money": ("USD;rate USD;paid USD;at USD;for USD;EUR;of USD", ";.;,; per day; daily; lump sum"),
    "position": ("position;in position;Position;in;at;en;bei;near", ";.;,; and; at {clock}; course {n3}"),
}


def _scrap(r: random.Random) -> str:
    mark = r.choice([*SCRAPS, "NAME", "NAME", "NAME", "ID_NUMBER", "PHONE", "vessel", "vessel", "town"])
    before, after = (r.choice(x.split(";")) for x in SCRAPS[mark])
    return f"{before}{'' if before in ('', '(', chr(10)) else ' '}{{{mark}}}{after}"


#: Words that the tagger knows by themselves: those of the sentences and of the fixed parts of values.
def vocabulary() -> set[str]:
    import regex

    fixed = SENTENCES.replace("\\n", " ") + " " + " ".join(f"{a} {b}" for a, b in SCRAPS.values()).replace(";", " ") + " Street Road Lane Ave Crescent Flat rue avenue quai de Calle Avenida C van der von Roads Bay Point Quay MV MT tug M V at dot AT ops Shipping Marine Bulk Carriers Agencies Chartering Towage Ship Supply Maritime Ltd GmbH SA Inc AS BV " + " ".join(" ".join(v) for v in _WORDS.values()) + " Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec example org com net test invalid mail crew fleet agency ships"
    return {w.lower() for w in regex.findall(r"\p{L}+", regex.sub(r"\{\w+\}", " ", fixed))}


def sequences(count: int, seed: int, forms: str = SENTENCES, scraps: bool = True) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts of one to four sentences, or scraps of such where ``scraps``, with their labelled spans (start, end, type); about a sixth is in capitals.

    A quarter has no personal information; of these, half have Capitals At All Words."""
    r = random.Random(seed)
    lines = [x.replace("\\n", "\n") for x in forms.strip().split("\n")]
    good, other = [x for x in lines if not x.startswith("- ")], [x[2:] for x in lines if x.startswith("- ")]
    out = []
    for k in range(count):
        text, spans = "", []
        join = r.choice([" ", " ", "\n", "\n\n"])
        for j in range(r.randint(1, 4)):
            line = good[k % len(good)] if j == 0 else r.choice(good) if r.random() < 0.35 else r.choice(other)
            if k % 4 == 0:
                line = r.choice(other)
            if scraps and k % 4 != 0 and r.random() < 0.45:
                line = _scrap(r)
            if line.endswith(".") and r.random() < 0.25:  # sentences often end in nothing
                line = line[:-1]
            text += join if text else ""
            for part in re.split(r"(\{\w+\})", _opened(line, r)):
                if part.startswith("{"):
                    value = _value(part[1:-1], r)
                    if part[1:-1].isupper():
                        spans.append((len(text), len(text) + len(value), part[1:-1]))
                    text += value
                else:
                    text += part
        if r.random() < 0.05:
            text, spans = f"<p>{text}</p>", [(a + 3, b + 3, kind) for a, b, kind in spans]
        draw = r.random()
        if draw < 0.18 and len(text.upper()) == len(text):
            text = text.upper().replace("<P>", "<p>").replace("</P>", "</p>")
        elif not spans and draw < 0.5:
            text = text.title()
        out.append((text, spans))
    return out
