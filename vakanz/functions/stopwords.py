"""Built-in stop words; larger lists are read from files (``sources.store.read_stop_words``)."""

from __future__ import annotations

# English stop words the results depend on. The list leaves out the pronouns
# that tell headings apart (you, your, our, we, are, have, i, me, my).
ENGLISH = (
    "myself ourselves yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those is was were be "
    "been being has had does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all both each "
    "few more most other some such no nor not only own same so than too very s t can will just "
    "don should now none None"
).split()

# Common German function words. Pronouns that tell headings apart (ihr, dein, du,
# sie, wir, uns, ich, sich) are not among them.
GERMAN = (
    "ab aber als also am an auch auf aus außer außerdem bei beide beim bevor bis bisher bitte bzw "
    "ca da dabei dadurch dafür dagegen daher dahin damit danach daneben dann daran darauf daraus "
    "darf darin darum darüber das dass davon davor dazu dem den denen denn dennoch der deren des "
    "deshalb dessen desto die doch dort durch dürfen eben ebenfalls ebenso eher ein eine einem "
    "einen einer eines einige einigen einiger einmal er erst es etwa etwas euch falls für ganz "
    "gegen genau genug gern haben hat hatte hier hinter hin ihm ihn im immer in indem innerhalb "
    "ins ist ja jede jedem jeden jeder jedes jedoch jetzt kein keine keinen keiner können könnte "
    "man manche mehr meine meinen meiner mit mittels muss müssen nach nachdem neben nein nicht "
    "nichts nie noch nun nur ob oben oder ohne per schon sehr sein seine seinen seit selbst sind "
    "so sobald sofern sogar solche somit sondern sonst soweit sowie über um und unten unter usw "
    "viel viele vom von vor war warum was weil weiter welche welchen welcher wenn wer werden wie "
    "wieder wird wo wurde zu zum zur zwar zwischen"
).split()

BUILT_IN = tuple(dict.fromkeys([*GERMAN, *ENGLISH]))
