"""Digests of the core forms of long licences (``license_scan.core``).

Made from the texts in /usr/share/common-licenses of Debian, each whole, without
its title, without its appendix ("how to apply", exhibits) and without both.
They hold for the core form as it is; after a change to it they must be made anew.
"""

# Fixed values: (license_id, SHA-256 of the core form).
DIGESTS = (
    ("Apache-2.0", "72083b058d325a216c948b17cd4a94aebe681e1c5b51a7106e6d5cb106b15480"),
    ("Apache-2.0", "832e3458d0873d4ea50171da58dcfc34664c8773ecef1dd883e4d35e59619603"),
    ("Apache-2.0", "03879208f1e2fa6aaf0facb5ba6c54995463447e37078fbb73a1b8963cf9ea82"),
    ("Apache-2.0", "12afe8048f59ad79be6a3a9c9fba5b71ade3ba8965d1557d59ea1e289309a048"),
    ("Apache-2.0", "4b7bf538613ad74324b8d88607299656873ed7b49b6f3b5b38c9e913571e248c"),
    ("Apache-2.0", "95a5e7b0aaa485a031d6c656da7677decafe7684bdad871ee9f1361e4ed340df"),
    ("Artistic-1.0-Perl", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("Artistic-1.0-Perl", "538e2e59281ba267abc1d1844748259521b4d2f0e90e9cca0ee2b8a86ffbe6fa"),
    ("BSD-3-Clause", "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060"),
    ("CC0-1.0", "fc3b7547cd22a69f533f8dc61ce0b9bba032990bd8d72935ddd5cf7045643f54"),
    ("CC0-1.0", "63892a2b4b76dd98e03e9248ea3612b33af011982b8b0b6a8849fad54473d192"),
    ("GFDL-1.2", "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d"),
    ("GFDL-1.2", "eccbb64a3a122210c2c49448b7fb99f60ff03e68a42c9af8ed4ec590e12f89f9"),
    ("GFDL-1.2", "6e3dcf0a9df58b4aba1321dbbaab4f7c8e66a8b3fec9d4d894754144d919612f"),
    ("GFDL-1.2", "7e7fcf0b18be94ede87110c1c148fbc2424881365f16ec00ad0635ba8ae4ba6f"),
    ("GFDL-1.3", "3e03599855be6f5154c1bba1c4189768a3518f5863527559438fa78fa2262af5"),
    ("GFDL-1.3", "58fe46d5b0a9e288e9846ade2247e7e90ad202f5e47439983c5c38595e8bebc6"),
    ("GFDL-1.3", "5b2b15c38f39851abc0a07da330bcd6ea11f87c9a862bf373f503ca2027d015c"),
    ("GFDL-1.3", "3e07b1165492027f3d7aa63c3edbb67c024c02d4641e319160dc5003e22e711a"),
    ("GPL-1.0", "fe80ccaae90d81557cc6613b788c47dd1819c7a5ae034f77e7d60bb6b879677e"),
    ("GPL-1.0", "bfd957e48c7a20bf32bfbcef058f91c9821e14c4d7ff37b88e0cb0542556037d"),
    ("GPL-1.0", "8779beee967ecd6ba7edd9e3c1f997470b1a2e73d9a5873e9f077a85b1e41497"),
    ("GPL-1.0", "3ada4bfa1cc9df1337fe187d007ded18727951adac30c912b50bd5b835de6f10"),
    ("GPL-1.0", "a7bce65e5dba16d91866e60621b8ba783a0a808bd63a601f8dc9eee8c8ae3441"),
    ("GPL-1.0", "2027f4e56be3c81d9e9c96e4a203ba0b3edc81db5b655b24f94760ba050c6fad"),
    ("GPL-2.0", "9c942f6942a3d44037aa20b92138b7de02aafd88adea708e7c93f34a145aeaa1"),
    ("GPL-2.0", "ea7215c322db26462e1212b85709124f2b1af2504fa29ab335ef62999ae3cb2b"),
    ("GPL-2.0", "7314c07a2d29e5446bcf514fee47b5f438deff8b1eed122fa2ee257c02b47bb7"),
    ("GPL-2.0", "d5d36790028635cfff13545c8573a41dfc8425dc0ae864d86517faec42a42bf5"),
    ("GPL-2.0", "aaf810f79057b02996d56055b9283d413e337af7e865d34d78ee9bb718d44586"),
    ("GPL-2.0", "61423207cbf268bee5bc17bc5a588e9fed666a54c58949aac91f825f534abde8"),
    ("GPL-3.0", "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64"),
    ("GPL-3.0", "fed4241aa4a095db62c00d728f8cb62a59bba59ca924dcaade64b714daf9c536"),
    ("GPL-3.0", "8c24ccf35998bd73317aa0801f6e6cbd865514baf55f246a48a8e890d1abc3d1"),
    ("GPL-3.0", "dd8b210925ce40dbe52f4c7eac2cc703150db11a78acf844b4a93e9db22a2d3c"),
    ("GPL-3.0", "a7d16b580457c566303df373fd362c5bfbfbc013734bed4e4cf732a569a5598e"),
    ("GPL-3.0", "4ee55f106a4606c43d942d8728947777455ea45e81dc6b06e4a18d43d2db72f1"),
    ("LGPL-2.0", "76e95bde887e452fdbf364b6e132f70904f43582182b76e0f71d88a2d8911ef7"),
    ("LGPL-2.0", "5195854597b29c0d2a227f7ed15e2f6ac031ae036a34d3503834ae9fcb52b8d7"),
    ("LGPL-2.0", "60a57d5c27c9e17b09b270fac9dc922bcf9e4d0e88247b5e4953eea523993c29"),
    ("LGPL-2.0", "9afa6d55ebb652c6fbdc115b9959b05bbffc32527e7f43979e6febe3df503382"),
    ("LGPL-2.0", "ed32a95bcbdc9599fe87bc123fbc3c553850a5eac0a093845318e0dd1b0d5cc0"),
    ("LGPL-2.0", "c5e3c5e074aedca1ae5f8466dff28fbb241e0bcb371b31523148a1f204c48d74"),
    ("LGPL-2.1", "3c172029ca14deedef915e5d03e83bcc73647736d10c2be07d384571ca06b440"),
    ("LGPL-2.1", "e338d5f96e0f6a8d6612392f22c1254fba705fd202fc6dad0d1436a4ab0c2797"),
    ("LGPL-2.1", "fc956b94c2648213f33a6d97d5d091ed6f082bac4e64a8f1ef02e9643a7a502c"),
    ("LGPL-2.1", "42822cb1450c43b700ce5be343a5502297d1bb3a5d6b0932cf81c4fbae310827"),
    ("LGPL-2.1", "f87ea650f4c0098f28d1c06569d297c73bb500f513ba5986481022013c9edee5"),
    ("LGPL-2.1", "3e58f90e40a1bc52b33c3cce6ea947c923a10d7e75c0a3d081e9652fa2f822d2"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("LGPL-3.0", "599e236ddcb69302837061770c9ad5f7b2e9908bdde58f1d38401c54304f7934"),
    ("MPL-1.1", "d9ccfd31ee11ba802d68a2ee7580461ed8595b505cfdfd1d5f5d35de245b9430"),
    ("MPL-1.1", "dd1344449b3745b9e9635e0ab4c9db0c3a21bcb52eedb5762852ecadd9ffd994"),
    ("MPL-1.1", "b8e6bf27be2c05bcf45e22eaf5c8e89c20925e7c9e68ad4fd8bedbc8228bd15a"),
    ("MPL-1.1", "425c59245ef1180d3b73cd10b6d7c9c7df4d89126e21d5356187948c78b8c242"),
    ("MPL-2.0", "aa5c44d0aab7700c72f599748e232b2cf7a5d8186f2e9604e9c04d11f1c283ee"),
    ("MPL-2.0", "79f68af5408f848ebca99e5fae9d3410a32b49db681fe3a186eb05f5080d0c97"),
    ("MPL-2.0", "221c111b2a879ee7ac8369e8c2c2e0a4e52b46ab62f6f7174424f20d2d9fd31b"),
    ("MPL-2.0", "0b91ac9d34512902485ff0a346eda586a41f7949901dd816e61cb35a85d43f36"),
)
