"""License wordings that the scan looks for unless told otherwise. Fixed values.

(label, text) pairs: the sentences by which public notices name a license, and the
whole texts of short licenses; a label may have several. Case and punctuation do
not matter. Longer license texts are read from a folder, see `licences.templates_in`.
"""

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC_END = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_GPL_END = "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"

TEMPLATES: list[tuple[str, str]] = [
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version {_GPL_END} you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2", f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version {_GPL_END} you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3 or any later version"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1.3 or any later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts a copy of the license is included in the section entitled gnu free documentation license"),
    ("mit", _MIT_GRANT),
    ("mit", f"{_MIT_GRANT} subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS}"),
    ("mit-0", f"{_MIT_GRANT} {_AS_IS}"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3", f"{_BSD_START} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}"),
    ("isc", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"),
    ("0bsd", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted {_ISC_END}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification you just do what the fuck you want to"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www eclipse org legal epl 2.0"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license"),
    ("eupl-1.2", "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence you may not use this work except in compliance with the licence"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1.1 this license is copied below and is also available with a faq at"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial license cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"),
    ("odbl", "this database is made available under the open database license any rights in individual contents of the database are licensed under the database contents license"),
]
