"""Examples of the CommonMark specification, section by section, and of GitHub's extensions."""

import pytest

from quern.sources import events

CASES = {
    "tabs": [("\tfoo\tbaz\t\tbim\n", "<pre><code>foo\tbaz\t\tbim\n</code></pre>\n"), ("    a\ta\n    ὐ\ta\n", "<pre><code>a\ta\nὐ\ta\n</code></pre>\n"), ("  - foo\n\n\tbar\n", "<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"), ("#\tFoo\n", "<h1>Foo</h1>\n"), ("*\t*\t*\t\n", "<hr />\n"), ("    foo\n\tbar\n", "<pre><code>foo\nbar\n</code></pre>\n")],
    "escapes": [("\\!\\\"\\#\\$\\%\\&\\'\\(\\)\\*\\+\\,\\-\\.\\/\\:\\;\\<\\=\\>\\?\\@\\[\\\\\\]\\^\\_\\`\\{\\|\\}\\~\n", "<p>!&quot;#$%&amp;'()*+,-./:;&lt;=&gt;?@[\\]^_`{|}~</p>\n"), ("\\\t\\A\\a\\ \\3\\φ\\«\n", "<p>\\\t\\A\\a\\ \\3\\φ\\«</p>\n"), ("\\\\*emphasis*\n", "<p>\\<em>emphasis</em></p>\n"), ("foo\\\nbar\n", "<p>foo<br />\nbar</p>\n"), ("`` \\[\\` ``\n", "<p><code>\\[\\`</code></p>\n"), ("    \\[\\]\n", "<pre><code>\\[\\]\n</code></pre>\n"), ("~~~\n\\[\\]\n~~~\n", "<pre><code>\\[\\]\n</code></pre>\n"), ("[foo](/bar\\* \"ti\\*tle\")\n", '<p><a href="/bar*" title="ti*tle">foo</a></p>\n'), ("[foo]\n\n[foo]: /bar\\* \"ti\\*tle\"\n", '<p><a href="/bar*" title="ti*tle">foo</a></p>\n'), ("``` foo\\+bar\nfoo\n```\n", '<pre><code class="language-foo+bar">foo\n</code></pre>\n')],
    "entities": [("&nbsp; &amp; &copy; &AElig; &Dcaron;\n&frac34; &HilbertSpace; &DifferentialD;\n&ClockwiseContourIntegral; &ngE;\n", "<p>\u00a0 &amp; © Æ Ď\n¾ ℋ ⅆ\n∲ ≧̸</p>\n"), ("&#35; &#1234; &#992; &#0;\n", "<p># Ӓ Ϡ \ufffd</p>\n"), ("&#X22; &#XD06; &#xcab;\n", "<p>&quot; ആ ಫ</p>\n"), ("&nbsp &x; &#; &#x;\n&#87654321;\n&#abcdef0;\n&ThisIsNotDefined; &hi?;\n", "<p>&amp;nbsp &amp;x; &amp;#; &amp;#x;\n&amp;#87654321;\n&amp;#abcdef0;\n&amp;ThisIsNotDefined; &amp;hi?;</p>\n"), ("&copy\n", "<p>&amp;copy</p>\n"), ("[foo](/f&ouml;&ouml; \"f&ouml;&ouml;\")\n", '<p><a href="/f%C3%B6%C3%B6" title="föö">foo</a></p>\n'), ("`f&ouml;&ouml;`\n", "<p><code>f&amp;ouml;&amp;ouml;</code></p>\n"), ("&#42;foo&#42;\n*foo*\n", "<p>*foo*\n<em>foo</em></p>\n"), ("&#42; foo\n\n* foo\n", "<p>* foo</p>\n<ul>\n<li>foo</li>\n</ul>\n"), ("foo&#10;&#10;bar\n", "<p>foo\n\nbar</p>\n"), ("[a](url &quot;tit&quot;)\n", "<p>[a](url &quot;tit&quot;)</p>\n")],
    "breaks": [("***\n---\n___\n", "<hr />\n<hr />\n<hr />\n"), ("+++\n", "<p>+++</p>\n"), ("--\n**\n__\n", "<p>--\n**\n__</p>\n"), ("    ***\n", "<pre><code>***\n</code></pre>\n"), ("Foo\n    ***\n", "<p>Foo\n***</p>\n"), (" **  * ** * ** * **\n", "<hr />\n"), ("_ _ _ _ a\n\na------\n\n---a---\n", "<p>_ _ _ _ a</p>\n<p>a------</p>\n<p>---a---</p>\n"), (" *-*\n", "<p><em>-</em></p>\n"), ("- foo\n***\n- bar\n", "<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>\n"), ("Foo\n***\nbar\n", "<p>Foo</p>\n<hr />\n<p>bar</p>\n"), ("Foo\n---\nbar\n", "<h2>Foo</h2>\n<p>bar</p>\n"), ("* Foo\n* * *\n* Bar\n", "<ul>\n<li>Foo</li>\n</ul>\n<hr />\n<ul>\n<li>Bar</li>\n</ul>\n"), ("- Foo\n- * * *\n", "<ul>\n<li>Foo</li>\n<li>\n<hr />\n</li>\n</ul>\n")],
    "headings": [("####### foo\n", "<p>####### foo</p>\n"), ("#5 bolt\n\n#hashtag\n", "<p>#5 bolt</p>\n<p>#hashtag</p>\n"), ("\\## foo\n", "<p>## foo</p>\n"), ("# foo *bar* \\*baz\\*\n", "<h1>foo <em>bar</em> *baz*</h1>\n"), ("#                  foo                     \n", "<h1>foo</h1>\n"), ("foo\n    # bar\n", "<p>foo\n# bar</p>\n"), ("## foo ##\n  ###   bar    ###\n", "<h2>foo</h2>\n<h3>bar</h3>\n"), ("### foo ### b\n", "<h3>foo ### b</h3>\n"), ("# foo#\n", "<h1>foo#</h1>\n"), ("### foo \\###\n## foo #\\##\n# foo \\#\n", "<h3>foo ###</h3>\n<h2>foo ###</h2>\n<h1>foo #</h1>\n"), ("## \n#\n### ###\n", "<h2></h2>\n<h1></h1>\n<h3></h3>\n"), ("Foo bar\n# baz\nBar foo\n", "<p>Foo bar</p>\n<h1>baz</h1>\n<p>Bar foo</p>\n")],
    "underlined": [("Foo *bar*\n=========\n\nFoo *bar*\n---------\n", "<h1>Foo <em>bar</em></h1>\n<h2>Foo <em>bar</em></h2>\n"), ("Foo *bar\nbaz*\n====\n", "<h1>Foo <em>bar\nbaz</em></h1>\n"), ("  Foo *bar\nbaz*\t\n====\n", "<h1>Foo <em>bar\nbaz</em></h1>\n"), ("    Foo\n    ---\n\n    Foo\n---\n", "<pre><code>Foo\n---\n\nFoo\n</code></pre>\n<hr />\n"), ("Foo\n    ---\n", "<p>Foo\n---</p>\n"), ("Foo\n= =\n\nFoo\n--- -\n", "<p>Foo\n= =</p>\n<p>Foo</p>\n<hr />\n"), ("`Foo\n----\n`\n\n<a title=\"a lot\n---\nof dashes\"/>\n", "<h2>`Foo</h2>\n<p>`</p>\n<h2>&lt;a title=&quot;a lot</h2>\n<p>of dashes&quot;/&gt;</p>\n"), ("> Foo\n---\n", "<blockquote>\n<p>Foo</p>\n</blockquote>\n<hr />\n"), ("> foo\nbar\n===\n", "<blockquote>\n<p>foo\nbar\n===</p>\n</blockquote>\n"), ("- Foo\n---\n", "<ul>\n<li>Foo</li>\n</ul>\n<hr />\n"), ("\n====\n", "<p>====</p>\n"), ("\\> foo\n------\n", "<h2>&gt; foo</h2>\n"), ("Foo\n\nbar\n---\nbaz\n", "<p>Foo</p>\n<h2>bar</h2>\n<p>baz</p>\n")],
    "indented": [("    a simple\n      indented code block\n", "<pre><code>a simple\n  indented code block\n</code></pre>\n"), ("  - foo\n\n    bar\n", "<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"), ("1.  foo\n\n    - bar\n", "<ol>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n</li>\n</ol>\n"), ("    chunk1\n\n    chunk2\n  \n \n \n    chunk3\n", "<pre><code>chunk1\n\nchunk2\n\n\n\nchunk3\n</code></pre>\n"), ("    chunk1\n      \n      chunk2\n", "<pre><code>chunk1\n  \n  chunk2\n</code></pre>\n"), ("    foo\nbar\n", "<pre><code>foo\n</code></pre>\n<p>bar</p>\n"), ("        foo\n    bar\n", "<pre><code>    foo\nbar\n</code></pre>\n"), ("\n    \n    foo\n    \n\n", "<pre><code>foo\n</code></pre>\n"), ("    foo  \n", "<pre><code>foo  \n</code></pre>\n")],
    "fenced": [("```\n<\n >\n```\n", "<pre><code>&lt;\n &gt;\n</code></pre>\n"), ("``\nfoo\n``\n", "<p><code>foo</code></p>\n"), ("```\naaa\n~~~\n```\n", "<pre><code>aaa\n~~~\n</code></pre>\n"), ("````\naaa\n```\n``````\n", "<pre><code>aaa\n```\n</code></pre>\n"), ("```\n", "<pre><code></code></pre>\n"), ("> ```\n> aaa\n\nbbb\n", "<blockquote>\n<pre><code>aaa\n</code></pre>\n</blockquote>\n<p>bbb</p>\n"), ("```\n\n  \n```\n", "<pre><code>\n  \n</code></pre>\n"), (" ```\n aaa\naaa\n```\n", "<pre><code>aaa\naaa\n</code></pre>\n"), ("   ```\n   aaa\n    aaa\n  aaa\n   ```\n", "<pre><code>aaa\n aaa\naaa\n</code></pre>\n"), ("```\naaa\n    ```\n", "<pre><code>aaa\n    ```\n</code></pre>\n"), ("``` ```\naaa\n", "<p><code> </code>\naaa</p>\n"), ("foo\n```\nbar\n```\nbaz\n", "<p>foo</p>\n<pre><code>bar\n</code></pre>\n<p>baz</p>\n"), ("~~~~    ruby startline=3 $%@#$\ndef foo(x)\n  return 3\nend\n~~~~~~~\n", '<pre><code class="language-ruby">def foo(x)\n  return 3\nend\n</code></pre>\n'), ("````;\n````\n", '<pre><code class="language-;"></code></pre>\n'), ("``` aa ```\nfoo\n", "<p><code>aa</code>\nfoo</p>\n"), ("~~~ aa ``` ~~~\nfoo\n~~~\n", '<pre><code class="language-aa">foo\n</code></pre>\n')],
    "html": [("<table><tr><td>\n<pre>\n**Hello**,\n\n_world_.\n</pre>\n</td></tr></table>\n", "<table><tr><td>\n<pre>\n**Hello**,\n<p><em>world</em>.\n</pre></p>\n</td></tr></table>\n"), (" <div>\n  *hello*\n         <foo><a>\n", " <div>\n  *hello*\n         <foo><a>\n"), ("</div>\n*foo*\n", "</div>\n*foo*\n"), ("<DIV CLASS=\"foo\">\n\n*Markdown*\n\n</DIV>\n", '<DIV CLASS="foo">\n<p><em>Markdown</em></p>\n</DIV>\n'), ("<div id=\"foo\"\n  class=\"bar\">\n</div>\n", '<div id="foo"\n  class="bar">\n</div>\n'), ("<del>\n*foo*\n</del>\n", "<del>\n*foo*\n</del>\n"), ("<del>\n\n*foo*\n\n</del>\n", "<del>\n<p><em>foo</em></p>\n</del>\n"), ("<del>*foo*</del>\n", "<p><del><em>foo</em></del></p>\n"), ("<!-- Foo\n\nbar\n   baz -->\nokay\n", "<!-- Foo\n\nbar\n   baz -->\n<p>okay</p>\n"), ("<?php\n\n  echo '>';\n\n?>\nokay\n", "<?php\n\n  echo '>';\n\n?>\n<p>okay</p>\n"), ("<!DOCTYPE html>\n", "<!DOCTYPE html>\n"), ("  <!-- foo -->\n\n    <!-- foo -->\n", "  <!-- foo -->\n<pre><code>&lt;!-- foo --&gt;\n</code></pre>\n"), ("Foo\n<div>\nbar\n</div>\n", "<p>Foo</p>\n<div>\nbar\n</div>\n"), ("Foo\n<a href=\"bar\">\nbaz\n", '<p>Foo\n<a href="bar">\nbaz</p>\n'), ("<div>*foo*</div>\n", "<div>*foo*</div>\n")],
    "references": [("[foo]: /url \"title\"\n\n[foo]\n", '<p><a href="/url" title="title">foo</a></p>\n'), ("   [foo]: \n      /url  \n           'the title'  \n\n[foo]\n", '<p><a href="/url" title="the title">foo</a></p>\n'), ("[Foo*bar\\]]:my_(url) 'title (with parens)'\n\n[Foo*bar\\]]\n", '<p><a href="my_(url)" title="title (with parens)">Foo*bar]</a></p>\n'), ("[foo]: /url '\ntitle\nline1\nline2\n'\n\n[foo]\n", '<p><a href="/url" title="\ntitle\nline1\nline2\n">foo</a></p>\n'), ("[foo]: /url 'title\n\nwith blank line'\n\n[foo]\n", "<p>[foo]: /url 'title</p>\n<p>with blank line'</p>\n<p>[foo]</p>\n"), ("[foo]:\n\n[foo]\n", "<p>[foo]:</p>\n<p>[foo]</p>\n"), ("[foo]: <>\n\n[foo]\n", '<p><a href="">foo</a></p>\n'), ("[foo]\n\n[foo]: first\n[foo]: second\n", '<p><a href="first">foo</a></p>\n'), ("[FOO]: /url\n\n[Foo]\n", '<p><a href="/url">Foo</a></p>\n'), ("[ΑΓΩ]: /φου\n\n[αγω]\n", '<p><a href="/%CF%86%CE%BF%CF%85">αγω</a></p>\n'), ("[foo]: /url\n", ""), ("[\nfoo\n]: /url\nbar\n", "<p>bar</p>\n"), ("[foo]: /url \"title\" ok\n", "<p>[foo]: /url &quot;title&quot; ok</p>\n"), ("[foo]: /url\n\"title\" ok\n", "<p>&quot;title&quot; ok</p>\n"), ("    [foo]: /url \"title\"\n\n[foo]\n", "<pre><code>[foo]: /url &quot;title&quot;\n</code></pre>\n<p>[foo]</p>\n"), ("Foo\n[bar]: /baz\n\n[bar]\n", "<p>Foo\n[bar]: /baz</p>\n<p>[bar]</p>\n"), ("# [Foo]\n[foo]: /url\n> bar\n", '<h1><a href="/url">Foo</a></h1>\n<blockquote>\n<p>bar</p>\n</blockquote>\n'), ("[foo]: /url\nbar\n===\n[foo]\n", '<h1>bar</h1>\n<p><a href="/url">foo</a></p>\n'), ("[foo]: /url\n===\n[foo]\n", '<p>===\n<a href="/url">foo</a></p>\n'), ("[foo]\n\n> [foo]: /url\n", '<p><a href="/url">foo</a></p>\n<blockquote>\n</blockquote>\n')],
    "paragraphs": [("aaa\n\n\nbbb\n", "<p>aaa</p>\n<p>bbb</p>\n"), ("  aaa\n bbb\n", "<p>aaa\nbbb</p>\n"), ("aaa\n             bbb\n                                       ccc\n", "<p>aaa\nbbb\nccc</p>\n"), ("    aaa\nbbb\n", "<pre><code>aaa\n</code></pre>\n<p>bbb</p>\n"), ("aaa     \nbbb     \n", "<p>aaa<br />\nbbb</p>\n"), ("  \n\naaa\n  \n\n# aaa\n\n  \n", "<p>aaa</p>\n<h1>aaa</h1>\n")],
    "quotes": [("> # Foo\n> bar\n> baz\n", "<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>\n"), ("># Foo\n>bar\n> baz\n", "<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>\n"), ("> bar\nbaz\n> foo\n", "<blockquote>\n<p>bar\nbaz\nfoo</p>\n</blockquote>\n"), ("> foo\n---\n", "<blockquote>\n<p>foo</p>\n</blockquote>\n<hr />\n"), ("> - foo\n- bar\n", "<blockquote>\n<ul>\n<li>foo</li>\n</ul>\n</blockquote>\n<ul>\n<li>bar</li>\n</ul>\n"), (">     foo\n    bar\n", "<blockquote>\n<pre><code>foo\n</code></pre>\n</blockquote>\n<pre><code>bar\n</code></pre>\n"), ("> ```\nfoo\n```\n", "<blockquote>\n<pre><code></code></pre>\n</blockquote>\n<p>foo</p>\n<pre><code></code></pre>\n"), ("> foo\n    - bar\n", "<blockquote>\n<p>foo\n- bar</p>\n</blockquote>\n"), (">\n", "<blockquote>\n</blockquote>\n"), ("> foo\n\n> bar\n", "<blockquote>\n<p>foo</p>\n</blockquote>\n<blockquote>\n<p>bar</p>\n</blockquote>\n"), ("> bar\n\nbaz\n", "<blockquote>\n<p>bar</p>\n</blockquote>\n<p>baz</p>\n"), ("> > > foo\nbar\n", "<blockquote>\n<blockquote>\n<blockquote>\n<p>foo\nbar</p>\n</blockquote>\n</blockquote>\n</blockquote>\n"), (">     code\n\n>    not code\n", "<blockquote>\n<pre><code>code\n</code></pre>\n</blockquote>\n<blockquote>\n<p>not code</p>\n</blockquote>\n")],
    "items": [("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.\n", "<ol>\n<li>\n<p>A paragraph\nwith two lines.</p>\n<pre><code>indented code\n</code></pre>\n<blockquote>\n<p>A block quote.</p>\n</blockquote>\n</li>\n</ol>\n"), ("- one\n\n two\n", "<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n"), (" -    one\n\n     two\n", "<ul>\n<li>one</li>\n</ul>\n<pre><code> two\n</code></pre>\n"), ("-one\n\n2.two\n", "<p>-one</p>\n<p>2.two</p>\n"), ("- foo\n\n\n  bar\n", "<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"), ("123456789. ok\n", '<ol start="123456789">\n<li>ok</li>\n</ol>\n'), ("1234567890. not ok\n", "<p>1234567890. not ok</p>\n"), ("0. ok\n", '<ol start="0">\n<li>ok</li>\n</ol>\n'), ("003. ok\n", '<ol start="3">\n<li>ok</li>\n</ol>\n'), ("-1. not ok\n", "<p>-1. not ok</p>\n"), ("- foo\n\n      bar\n", "<ul>\n<li>\n<p>foo</p>\n<pre><code>bar\n</code></pre>\n</li>\n</ul>\n"), ("1.     indented code\n\n   paragraph\n\n       more code\n", "<ol>\n<li>\n<pre><code>indented code\n</code></pre>\n<p>paragraph</p>\n<pre><code>more code\n</code></pre>\n</li>\n</ol>\n"), ("-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz\n", "<ul>\n<li>foo</li>\n<li>\n<pre><code>bar\n</code></pre>\n</li>\n<li>\n<pre><code>baz\n</code></pre>\n</li>\n</ul>\n"), ("-\n\n  foo\n", "<ul>\n<li></li>\n</ul>\n<p>foo</p>\n"), ("- foo\n-\n- bar\n", "<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>\n"), ("foo\n*\n\nfoo\n1.\n", "<p>foo\n*</p>\n<p>foo\n1.</p>\n"), ("  1.  A paragraph\nwith two lines.\n", "<ol>\n<li>A paragraph\nwith two lines.</li>\n</ol>\n"), ("> 1. > Blockquote\ncontinued here.\n", "<blockquote>\n<ol>\n<li>\n<blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote>\n</li>\n</ol>\n</blockquote>\n"), ("- foo\n  - bar\n    - baz\n      - boo\n", "<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>baz\n<ul>\n<li>boo</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n"), ("- foo\n - bar\n  - baz\n   - boo\n", "<ul>\n<li>foo</li>\n<li>bar</li>\n<li>baz</li>\n<li>boo</li>\n</ul>\n"), ("10) foo\n    - bar\n", '<ol start="10">\n<li>foo\n<ul>\n<li>bar</li>\n</ul>\n</li>\n</ol>\n'), ("- - foo\n", "<ul>\n<li>\n<ul>\n<li>foo</li>\n</ul>\n</li>\n</ul>\n"), ("- # Foo\n- Bar\n  ---\n  baz\n", "<ul>\n<li>\n<h1>Foo</h1>\n</li>\n<li>\n<h2>Bar</h2>\nbaz</li>\n</ul>\n")],
    "lists": [("- foo\n- bar\n+ baz\n", "<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<ul>\n<li>baz</li>\n</ul>\n"), ("1. foo\n2. bar\n3) baz\n", '<ol>\n<li>foo</li>\n<li>bar</li>\n</ol>\n<ol start="3">\n<li>baz</li>\n</ol>\n'), ("Foo\n- bar\n- baz\n", "<p>Foo</p>\n<ul>\n<li>bar</li>\n<li>baz</li>\n</ul>\n"), ("The number of windows in my house is\n14.  The number of doors is 6.\n", "<p>The number of windows in my house is\n14.  The number of doors is 6.</p>\n"), ("- foo\n\n- bar\n\n\n- baz\n", "<ul>\n<li>\n<p>foo</p>\n</li>\n<li>\n<p>bar</p>\n</li>\n<li>\n<p>baz</p>\n</li>\n</ul>\n"), ("- foo\n- bar\n\n<!-- -->\n\n- baz\n- bim\n", "<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<!-- -->\n<ul>\n<li>baz</li>\n<li>bim</li>\n</ul>\n"), ("- a\n - b\n  - c\n   - d\n    - e\n", "<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d\n- e</li>\n</ul>\n"), ("- a\n- b\n\n- c\n", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"), ("* a\n*\n\n* c\n", "<ul>\n<li>\n<p>a</p>\n</li>\n<li></li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"), ("- a\n- b\n\n  c\n- d\n", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n<li>\n<p>d</p>\n</li>\n</ul>\n"), ("- a\n- b\n\n  [ref]: /url\n- d\n", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>d</p>\n</li>\n</ul>\n"), ("- a\n- ```\n  b\n\n\n  ```\n- c\n", "<ul>\n<li>a</li>\n<li>\n<pre><code>b\n\n\n</code></pre>\n</li>\n<li>c</li>\n</ul>\n"), ("- a\n  - b\n\n    c\n- d\n", "<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"), ("* a\n  > b\n  >\n* c\n", "<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n</li>\n<li>c</li>\n</ul>\n"), ("- a\n  > b\n  ```\n  c\n  ```\n- d\n", "<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n<pre><code>c\n</code></pre>\n</li>\n<li>d</li>\n</ul>\n"), ("1. ```\n   foo\n   ```\n\n   bar\n", "<ol>\n<li>\n<pre><code>foo\n</code></pre>\n<p>bar</p>\n</li>\n</ol>\n"), ("* foo\n  * bar\n\n  baz\n", "<ul>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n<p>baz</p>\n</li>\n</ul>\n"), ("- a\n  - b\n  - c\n\n- d\n  - e\n  - f\n", "<ul>\n<li>\n<p>a</p>\n<ul>\n<li>b</li>\n<li>c</li>\n</ul>\n</li>\n<li>\n<p>d</p>\n<ul>\n<li>e</li>\n<li>f</li>\n</ul>\n</li>\n</ul>\n")],
    "code": [("`` foo ` bar ``\n", "<p><code>foo ` bar</code></p>\n"), ("` `` `\n", "<p><code>``</code></p>\n"), ("`  ``  `\n", "<p><code> `` </code></p>\n"), ("` a`\n", "<p><code> a</code></p>\n"), ("` `\n`  `\n", "<p><code> </code>\n<code>  </code></p>\n"), ("``\nfoo\nbar  \nbaz\n``\n", "<p><code>foo bar   baz</code></p>\n"), ("`foo\\`bar`\n", "<p><code>foo\\</code>bar`</p>\n"), ("*foo`*`\n", "<p>*foo<code>*</code></p>\n"), ("[not a `link](/foo`)\n", "<p>[not a <code>link](/foo</code>)</p>\n"), ("`<a href=\"`\">`\n", "<p><code>&lt;a href=&quot;</code>&quot;&gt;`</p>\n"), ("<a href=\"`\">`\n", '<p><a href="`">`</p>\n'), ("<https://foo.bar.`baz>`\n", '<p><a href="https://foo.bar.%60baz">https://foo.bar.`baz</a>`</p>\n'), ("```foo``\n", "<p>```foo``</p>\n"), ("`foo``bar``\n", "<p>`foo<code>bar</code></p>\n")],
    "emphasis": [("a * foo bar*\n", "<p>a * foo bar*</p>\n"), ('a*"foo"*\n', "<p>a*&quot;foo&quot;*</p>\n"), ("*\u00a0a\u00a0*\n", "<p>*\u00a0a\u00a0*</p>\n"), ("foo*bar*\n", "<p>foo<em>bar</em></p>\n"), ("foo_bar_\n", "<p>foo_bar_</p>\n"), ("пристаням_стремятся_\n", "<p>пристаням_стремятся_</p>\n"), ('aa_"bb"_cc\n', "<p>aa_&quot;bb&quot;_cc</p>\n"), ("foo-_(bar)_\n", "<p>foo-<em>(bar)</em></p>\n"), ("*(*foo)\n", "<p>*(*foo)</p>\n"), ("*(*foo*)*\n", "<p><em>(<em>foo</em>)</em></p>\n"), ("_foo_bar_baz_\n", "<p><em>foo_bar_baz</em></p>\n"), ("** foo bar**\n", "<p>** foo bar**</p>\n"), ("__foo, __bar__, baz__\n", "<p><strong>foo, <strong>bar</strong>, baz</strong></p>\n"), ("**foo \"*bar*\" foo**\n", "<p><strong>foo &quot;<em>bar</em>&quot; foo</strong></p>\n"), ("**foo**bar\n", "<p><strong>foo</strong>bar</p>\n"), ("*foo\nbar*\n", "<p><em>foo\nbar</em></p>\n"), ("_foo __bar__ baz_\n", "<p><em>foo <strong>bar</strong> baz</em></p>\n"), ("*foo**bar**baz*\n", "<p><em>foo<strong>bar</strong>baz</em></p>\n"), ("*foo**bar*\n", "<p><em>foo**bar</em></p>\n"), ("***foo** bar*\n", "<p><em><strong>foo</strong> bar</em></p>\n"), ("foo***bar***baz\n", "<p>foo<em><strong>bar</strong></em>baz</p>\n"), ("foo******bar*********baz\n", "<p>foo<strong><strong><strong>bar</strong></strong></strong>***baz</p>\n"), ("*foo **bar *baz* bim** bop*\n", "<p><em>foo <strong>bar <em>baz</em> bim</strong> bop</em></p>\n"), ("** is not an empty emphasis\n", "<p>** is not an empty emphasis</p>\n"), ("**foo*\n", "<p>*<em>foo</em></p>\n"), ("*foo**\n", "<p><em>foo</em>*</p>\n"), ("***foo**\n", "<p>*<strong>foo</strong></p>\n"), ("foo *\\**\n", "<p>foo <em>*</em></p>\n"), ("foo __\\___\n", "<p>foo <strong>_</strong></p>\n"), ("******foo******\n", "<p><strong><strong><strong>foo</strong></strong></strong></p>\n"), ("***foo***\n", "<p><em><strong>foo</strong></em></p>\n"), ("_____foo_____\n", "<p><em><strong><strong>foo</strong></strong></em></p>\n"), ("*foo _bar* baz_\n", "<p><em>foo _bar</em> baz_</p>\n"), ("**foo **bar baz**\n", "<p>**foo <strong>bar baz</strong></p>\n"), ("*[bar*](/url)\n", '<p>*<a href="/url">bar*</a></p>\n'), ("*<img src=\"foo\" title=\"*\"/>\n", '<p>*<img src="foo" title="*"/></p>\n'), ("*a `*`*\n", "<p><em>a <code>*</code></em></p>\n"), ("**a<https://foo.bar/?q=**>\n", '<p>**a<a href="https://foo.bar/?q=**">https://foo.bar/?q=**</a></p>\n')],
    "links": [("[link](/uri \"title\")\n", '<p><a href="/uri" title="title">link</a></p>\n'), ("[](./target.md)\n", '<p><a href="./target.md"></a></p>\n'), ("[link]()\n", '<p><a href="">link</a></p>\n'), ("[link](</my uri>)\n", '<p><a href="/my%20uri">link</a></p>\n'), ("[link](/my uri)\n", "<p>[link](/my uri)</p>\n"), ("[link](foo\nbar)\n", "<p>[link](foo\nbar)</p>\n"), ("[a](<b)c>)\n", '<p><a href="b)c">a</a></p>\n'), ("[link](\\(foo\\))\n", '<p><a href="(foo)">link</a></p>\n'), ("[link](foo(and(bar)))\n", '<p><a href="foo(and(bar))">link</a></p>\n'), ("[link](foo\\)\\:)\n", '<p><a href="foo):">link</a></p>\n'), ("[link](foo\\bar)\n", '<p><a href="foo%5Cbar">link</a></p>\n'), ("[link](foo%20b&auml;)\n", '<p><a href="foo%20b%C3%A4">link</a></p>\n'), ("[link](/url \"title \\\"&quot;\")\n", '<p><a href="/url" title="title &quot;&quot;">link</a></p>\n'), ("[link](/url 'title \"and\" title')\n", '<p><a href="/url" title="title &quot;and&quot; title">link</a></p>\n'), ("[link] (/uri)\n", "<p>[link] (/uri)</p>\n"), ("[link [foo [bar]]](/uri)\n", '<p><a href="/uri">link [foo [bar]]</a></p>\n'), ("[link [bar](/uri)\n", '<p>[link <a href="/uri">bar</a></p>\n'), ("[link *foo **bar** `#`*](/uri)\n", '<p><a href="/uri">link <em>foo <strong>bar</strong> <code>#</code></em></a></p>\n'), ("[![moon](moon.jpg)](/uri)\n", '<p><a href="/uri"><img src="moon.jpg" alt="moon" /></a></p>\n'), ("[foo [bar](/uri)](/uri)\n", '<p>[foo <a href="/uri">bar</a>](/uri)</p>\n'), ("*[foo*](/uri)\n", '<p>*<a href="/uri">foo*</a></p>\n'), ("[foo`](/uri)`\n", "<p>[foo<code>](/uri)</code></p>\n"), ("[foo][bar]\n\n[bar]: /url \"title\"\n", '<p><a href="/url" title="title">foo</a></p>\n'), ("[link [foo [bar]]][ref]\n\n[ref]: /uri\n", '<p><a href="/uri">link [foo [bar]]</a></p>\n'), ("[foo][BaR]\n\n[bar]: /url \"title\"\n", '<p><a href="/url" title="title">foo</a></p>\n'), ("[ẞ]\n\n[SS]: /url\n", '<p><a href="/url">ẞ</a></p>\n'), ("[foo] [bar]\n\n[bar]: /url \"title\"\n", '<p>[foo] <a href="/url" title="title">bar</a></p>\n'), ("[foo]\n\n[foo]: /url1\n\n[foo]: /url2\n\n[bar][foo]\n", '<p><a href="/url1">foo</a></p>\n<p><a href="/url1">bar</a></p>\n'), ("[bar][foo\\!]\n\n[foo!]: /url\n", "<p>[bar][foo!]</p>\n"), ("[foo][ref[]\n\n[ref[]: /uri\n", "<p>[foo][ref[]</p>\n<p>[ref[]: /uri</p>\n"), ("[bar\\\\]: /uri\n\n[bar\\\\]\n", '<p><a href="/uri">bar\\</a></p>\n'), ("[]\n\n[]: /uri\n", "<p>[]</p>\n<p>[]: /uri</p>\n"), ("[foo][]\n\n[foo]: /url \"title\"\n", '<p><a href="/url" title="title">foo</a></p>\n'), ("[*foo* bar][]\n\n[*foo* bar]: /url \"title\"\n", '<p><a href="/url" title="title"><em>foo</em> bar</a></p>\n'), ("[[*foo* bar]]\n\n[*foo* bar]: /url \"title\"\n", '<p>[<a href="/url" title="title"><em>foo</em> bar</a>]</p>\n'), ("[[bar [foo]\n\n[foo]: /url\n", '<p>[[bar <a href="/url">foo</a></p>\n'), ("\\[foo]\n\n[foo]: /url \"title\"\n", "<p>[foo]</p>\n"), ("*[foo*]\n\n[foo*]: /url\n", '<p>*<a href="/url">foo*</a></p>\n'), ("[foo](not a link)\n\n[foo]: /url1\n", '<p><a href="/url1">foo</a>(not a link)</p>\n'), ("[foo][bar][baz]\n\n[baz]: /url\n", '<p>[foo]<a href="/url">bar</a></p>\n'), ("[foo][bar][baz]\n\n[baz]: /url1\n[bar]: /url2\n", '<p><a href="/url2">foo</a><a href="/url1">baz</a></p>\n')],
    "images": [("![foo](/url \"title\")\n", '<p><img src="/url" alt="foo" title="title" /></p>\n'), ("![foo *bar*]\n\n[foo *bar*]: train.jpg \"train & tracks\"\n", '<p><img src="train.jpg" alt="foo bar" title="train &amp; tracks" /></p>\n'), ("![foo ![bar](/url)](/url2)\n", '<p><img src="/url2" alt="foo bar" /></p>\n'), ("![foo [bar](/url)](/url2)\n", '<p><img src="/url2" alt="foo bar" /></p>\n'), ("![](/url)\n", '<p><img src="/url" alt="" /></p>\n'), ("![[foo]]\n\n[[foo]]: /url2\n", "<p>![[foo]]</p>\n<p>[[foo]]: /url2</p>\n"), ("!\\[foo]\n\n[foo]: /url\n", "<p>![foo]</p>\n"), ("\\![foo]\n\n[foo]: /url\n", '<p>!<a href="/url">foo</a></p>\n')],
    "raw": [("<http://foo.bar.baz>\n", '<p><a href="http://foo.bar.baz">http://foo.bar.baz</a></p>\n'), ("<MAILTO:FOO@BAR.BAZ>\n", '<p><a href="MAILTO:FOO@BAR.BAZ">MAILTO:FOO@BAR.BAZ</a></p>\n'), ("<a+b+c:d>\n", '<p><a href="a+b+c:d">a+b+c:d</a></p>\n'), ("<foo@bar.example.com>\n", '<p><a href="mailto:foo@bar.example.com">foo@bar.example.com</a></p>\n'), ("<>\n", "<p>&lt;&gt;</p>\n"), ("<a><bab><c2c>\n", "<p><a><bab><c2c></p>\n"), ("<a/><b2/>\n", "<p><a/><b2/></p>\n"), ("<33> <__>\n", "<p>&lt;33&gt; &lt;__&gt;</p>\n"), ("<a h*#ref=\"hi\">\n", "<p>&lt;a h*#ref=&quot;hi&quot;&gt;</p>\n"), ("< a><\nfoo><bar/ >\n<foo bar=baz\nbim!bop />\n", "<p>&lt; a&gt;&lt;\nfoo&gt;&lt;bar/ &gt;\n&lt;foo bar=baz\nbim!bop /&gt;</p>\n"), ("</a></foo >\n", "<p></a></foo ></p>\n"), ("foo <!-- this is a --\ncomment - with hyphens -->\n", "<p>foo <!-- this is a --\ncomment - with hyphens --></p>\n"), ("foo <?php echo $a; ?>\n", "<p>foo <?php echo $a; ?></p>\n"), ("foo <!ELEMENT br EMPTY>\n", "<p>foo <!ELEMENT br EMPTY></p>\n"), ("foo <![CDATA[>&<]]>\n", "<p>foo <![CDATA[>&<]]></p>\n"), ("foo <a href=\"&ouml;\">\n", '<p>foo <a href="&ouml;"></p>\n')],
    "line ends": [("foo  \nbaz\n", "<p>foo<br />\nbaz</p>\n"), ("foo       \nbaz\n", "<p>foo<br />\nbaz</p>\n"), ("foo  \n     bar\n", "<p>foo<br />\nbar</p>\n"), ("*foo  \nbar*\n", "<p><em>foo<br />\nbar</em></p>\n"), ("`code  \nspan`\n", "<p><code>code   span</code></p>\n"), ("<a href=\"foo  \nbar\">\n", '<p><a href="foo  \nbar"></p>\n'), ("foo\\\n", "<p>foo\\</p>\n"), ("foo  \n", "<p>foo</p>\n"), ("### foo\\\n", "<h3>foo\\</h3>\n"), ("### foo  \n", "<h3>foo</h3>\n"), ("foo\nbaz\n", "<p>foo\nbaz</p>\n"), ("foo \n baz\n", "<p>foo\nbaz</p>\n"), ("Multiple     spaces\n", "<p>Multiple     spaces</p>\n")],
    "extensions": [("| foo | bar |\n| --- | --- |\n| baz | bim |\n", "<table>\n<thead>\n<tr>\n<th>foo</th>\n<th>bar</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>baz</td>\n<td>bim</td>\n</tr>\n</tbody>\n</table>\n"), ("| f\\|oo  |\n| ------ |\n| b `\\|` az |\n| b **\\|** im |\n", "<table>\n<thead>\n<tr>\n<th>f|oo</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>b <code>|</code> az</td>\n</tr>\n<tr>\n<td>b <strong>|</strong> im</td>\n</tr>\n</tbody>\n</table>\n"), ("| abc | def |\n| --- |\n| bar |\n", "<p>| abc | def |\n| --- |\n| bar |</p>\n"), ("~~Hi~~ Hello, ~there~ world!\n", "<p><del>Hi</del> Hello, <del>there</del> world!</p>\n"), ("This ~~has a\n\nnew paragraph~~.\n", "<p>This ~~has a</p>\n<p>new paragraph~~.</p>\n"), ("This will ~~~not~~~ strike.\n", "<p>This will ~~~not~~~ strike.</p>\n"), ("www.google.com/search?q=Markup+(business)\n\nwww.google.com/search?q=Markup+(business)))\n", '<p><a href="http://www.google.com/search?q=Markup+(business)">www.google.com/search?q=Markup+(business)</a></p>\n<p><a href="http://www.google.com/search?q=Markup+(business)">www.google.com/search?q=Markup+(business)</a>))</p>\n'), ("www.commonmark.org/he<lp\n", '<p><a href="http://www.commonmark.org/he">www.commonmark.org/he</a>&lt;lp</p>\n'), ("xmpp:a@b.c/message.\n", '<p><a href="xmpp:a@b.c/message">xmpp:a@b.c/message</a>.</p>\n'), ("![http://a.b/c](http://a.b/c)\n", '<p><img src="http://a.b/c" alt="http://a.b/c" /></p>\n'), ("<strong> <title> <style> <em>\n", "<p><strong> &lt;title> &lt;style> <em></p>\n")],
}


@pytest.mark.parametrize("section", CASES)
def test_examples(section):
    wrong = []
    for markdown, html in CASES[section]:
        if (got := events.write_html(events.read_markdown(markdown))) != html:
            wrong.append((markdown, html, got))
    assert not wrong, f"{len(wrong)} of {len(CASES[section])}: {wrong}"
