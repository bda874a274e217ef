from chronofold.llm import latex


def plain(text):
    return [b" ".join(w).decode() for w in latex.sentences(text)]


def test_visible_prose():
    text = r"""\documentclass{article}
\newcommand{\abX}{heat flow\xspace}
\def\cdQ{cold front}
\newcommand{\term}[1]{\emph{#1}}
\title{Not a sentence here}
\begin{document}
\section{Nor this one}
The \abX{} meets the \cdQ\ at $x = 5.3$ and \term{now} rises~\cite{ab12}. It \textbf{is} {\it well} known. % hidden words here
%% All of this is hidden.
\begin{comment}
Hidden too, all of it.
\end{comment}
\iffalse Hidden again by this. \fi
\begin{equation}\label{e} a = b. C D E \end{equation}
Gr\"o\ss e und Bew\-eis sind Gr{\"o}\ss{}en, d\'ej\`a vu.
\begin{thebibliography}{9} \bibitem{x} A. Bc, \emph{Title of it}. \end{thebibliography}
\end{document}
After the end of it."""
    assert plain(text) == [
        "the heat flow meets the cold front at and now rises", "it is well known", "grosse und beweis sind grossen deja vu",
    ]


def test_odd_texts():
    assert latex.sentences(None) == [] and latex.sentences("") == [] and latex.sentences("% empty draft\n") == []
    assert plain(r"\begin{document} One two three. \begin{comment} never closed, all hidden") == ["one two three"]
    assert plain("Plain text only here, cafÃ© und été. Second one it is.") == ["plain text only here cafe und ete", "second one it is"]
    assert plain(r"One two three. \bibitem{a} Hidden words in list.") == ["one two three"]
    assert plain("a" * 100_000) == ["a" * 100_000]
    assert len(plain("One two three. " * 20_000)) == 20_000
    assert plain(r"50\% of them fell. {{{ unbalanced $ maths here now") != []


def test_definitions_and_macros():
    deep = r"\newcommand{\aa@}{\bb x}\newcommand{\bb}{\cc x}\newcommand{\cc}{\dd x}\newcommand\dd{\ee{} x}\def\ee{\ff x}\def\ff{bottom}Five \aa@ levels."
    assert plain(deep) == ["five bottom levels"]
    assert plain(r"\newcommand{\fld}[1]{deep #1 field}See the \fld{wide} here.") == ["see the deep wide field here"]
    assert plain(r"\newcommand{\two}[2][red]{#1 and #2}Is \two{blue} or \two[green]{\textbf{grey}} it.") == ["is red and blue or green and grey it"]
    assert plain(r"\def\pair#1#2{#2 then #1}First \pair{one}{two} end.") == ["first two then one end"]
    assert plain(r"\newcommand{\nest}{a {b {cc {dd {ee {ff}}}}} gg}The \nest{} holds.") == ["the cc dd ee ff gg holds"]
    assert plain(r"\newcommand{\loopa}{xx \loopb}\newcommand{\loopb}{yy \loopa}It \loopa{} ends.") == ["it xx yy ends"]
    assert plain(r"\let\old=\new \newcommand{\new}{fresh air}The \old{} one.") == ["the fresh air one"]
    assert plain(r"\newenvironment{box}{hidden begin}{hidden end}Only this.") == ["only this"]
    boom = "".join(rf"\newcommand{{\m{chr(97 + i)}}}{{\m{chr(98 + i)}\m{chr(98 + i)} }}" for i in range(25)) + r"\newcommand{\mz}{boom }\ma end."
    assert len(latex.visible(boom)) < 2_000_000


def test_scripts_and_short_sentences():
    assert plain("Yes. It rains. Ja!") == ["yes", "it rains", "ja"]
    assert plain("Теорема о границе доказана. Это важно.") == ["теорема о границе доказана".replace(" о ", " "), "это важно"]
    assert plain("Η θεωρία ισχύει.") == ["θεωρια ισχυει"]
    assert plain("数学证明。定理") == ["数学 学证 证明", "定理"]
